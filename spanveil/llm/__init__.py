"""Operators for large training-data pipelines (dedup, filtering, scoring, search).

Nothing else in the library imports this subpackage.
"""
