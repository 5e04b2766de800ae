"""Operators for training-data pipelines.

Each ``opN`` module holds one operator with a general interface plus the thin
query that applies it to its whole table.  ``registry`` collects the queries
and their SQL.  Nothing outside this subpackage imports it.
"""
