"""Scalar operators and aggregates as typed Spark columns."""
