"""Query language: text -> syntax tree -> DataFrame."""
