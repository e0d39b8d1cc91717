"""Retrieval and training-data analytics as Spark plans."""
