"""Scalar functions as Column expressions; Python only where SQL has no counterpart."""
