"""Operators for preparing training text: one module per operator, queries in ``queries.py``.

Every operator selects the columns it names before it adds its own, so other columns of the
input, whatever they are called, never clash with working columns.
"""
