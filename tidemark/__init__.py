"""Tidemark: a federated analytics engine written on PySpark's DataFrame and SQL API."""

__version__ = "0.1.0"
