"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing else in the package imports this subpackage. ``queries.py`` registers one query
per operator; the operators themselves take DataFrames and keep a general interface.
"""
