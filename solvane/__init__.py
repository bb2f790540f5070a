"""Molecular property analytics as PySpark DataFrame transformations."""
