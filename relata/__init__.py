"""Relata: open information extraction and ontology induction as PySpark DataFrame operators."""
