"""Corpus and retrieval-QA analytics on PySpark."""
