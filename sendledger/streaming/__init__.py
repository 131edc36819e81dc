"""Continuous loads and running counts."""
