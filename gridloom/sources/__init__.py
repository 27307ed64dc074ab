"""Matrices from tables, and datasets on disk."""
