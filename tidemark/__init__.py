"""Searchable, self-describing event streams as Spark DataFrame operations."""

__version__ = "0.1.0"
