"""Graphs from tables, files in and out, statements that aren't queries."""
