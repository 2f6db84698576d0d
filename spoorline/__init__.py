"""Spark operators for re-identification evaluation sets and field-observation logs."""

__version__ = "0.1.0"
