"""Operators on tables and on pairs of tables."""
