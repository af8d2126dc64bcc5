"""Retrieval, routing and evaluation analytics over linked document corpora, as Spark DataFrame operators."""
