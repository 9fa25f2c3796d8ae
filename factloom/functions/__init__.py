"""Scalar functions as Column expressions: hashing, strings, vector algebra."""
