"""Queries that run the operators on the test tables, and their SQL twins."""
