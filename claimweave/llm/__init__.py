"""Operators for preparing training data: one module per operator, each with its registered query."""
