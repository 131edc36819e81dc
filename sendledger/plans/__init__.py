"""Loads: from input rows to the stored tables."""
