"""Declarative data preparation compiled to Spark plans."""
