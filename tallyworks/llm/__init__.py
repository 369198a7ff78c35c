"""Operators of a training-data pipeline: filters, redaction, near-duplicates, mixing, tokens.

Nothing else in the package imports from here.
"""
