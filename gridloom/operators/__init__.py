"""Operators over sparse matrices."""
