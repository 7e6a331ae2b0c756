"""Retrieval, ranking and corpus analytics as declarative PySpark plans."""
