"""Operators of a training-data pipeline: one module each, plus their queries.

Nothing else in the library imports this subpackage.
"""
