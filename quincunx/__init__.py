"""Nearest-neighbour risk scoring and data processing on PySpark."""
