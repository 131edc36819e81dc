"""Joins, aggregations and reports over the stored tables."""
