"""Operators of a training-data pipeline, each written for tables far larger than one machine.

One module holds one operator; :mod:`lattica.llm.queries` registers the query of each.
"""
