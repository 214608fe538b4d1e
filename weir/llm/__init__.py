"""Operators for large text collections."""
