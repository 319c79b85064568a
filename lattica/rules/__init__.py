"""Recursive rules with monotone and probabilistic aggregates over a graph."""
