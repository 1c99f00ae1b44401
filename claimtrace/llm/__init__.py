"""Operators of a training-data pipeline: one module for each, and one ``queries`` module.

Nothing else in ``claimtrace`` imports this subpackage.
"""
