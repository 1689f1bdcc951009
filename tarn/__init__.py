"""Retrieval and analytics over source code, documents and project history, on PySpark."""
