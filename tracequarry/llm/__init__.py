"""Operators of a training-data pipeline: filtering, deduplication, scoring, formatting, encoding.

Nothing else in the library imports this subpackage.
"""
