"""Markup-corpus analytics as PySpark DataFrame operations."""
