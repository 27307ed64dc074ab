"""Whole plans and the queries that show them."""
