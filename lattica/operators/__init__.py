"""Operators behind the clauses: paths, search, algorithms, writes."""
