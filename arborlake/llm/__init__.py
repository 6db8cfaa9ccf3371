"""Operators for preparing large text corpora (subpackage ``llm``).

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Every operator takes and returns DataFrames and keeps its own columns
under names that cannot clash with the columns it is given.
"""
