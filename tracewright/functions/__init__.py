"""Scalar functions: text patterns and statistics."""
