"""Scalar functions and statistics."""
