"""Scalar and array Column expressions."""
