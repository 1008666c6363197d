"""Scalar functions and the method table."""
