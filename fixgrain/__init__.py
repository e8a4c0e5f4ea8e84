"""Findings curation engine expressed as PySpark DataFrame transformations."""
