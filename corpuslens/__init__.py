"""Retrieval analytics over document corpora, as Spark DataFrame operators."""
