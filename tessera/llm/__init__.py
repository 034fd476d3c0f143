"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
queries that apply each operator to its whole table; every operator module
documents its own treatment of nulls, empty input, ties and repeated rows.
"""
