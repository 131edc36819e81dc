"""Readers for the input files and for the month-partitioned store."""
