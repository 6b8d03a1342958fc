"""Operators for preparing training data at scale.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside this
subpackage imports it; its registered queries are in ``queries.py``.
"""
