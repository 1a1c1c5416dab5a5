"""Deterministic document-evidence analytics as PySpark DataFrame plans."""
