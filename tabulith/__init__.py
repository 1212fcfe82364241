"""Preparing tables, and comparing a real table with synthetic copies of it, on Spark."""
