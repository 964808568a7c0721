"""Operators, one module per subject."""
