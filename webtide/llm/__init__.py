"""Operators for large-scale training-data pipelines.

One module per operator; each has a general interface over DataFrames and
says in its docstring what it does with nulls, empty and very long texts,
ties, repeated rows and empty tables. ``queries`` holds the thin registered
queries and their SQL. Nothing else in the library imports this package.
"""
