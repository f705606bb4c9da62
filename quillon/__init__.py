"""Ontology annotation and corpus processing as PySpark DataFrame jobs."""
