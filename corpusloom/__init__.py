"""Corpus analytics on PySpark: text relations, ranking, scoring and corpus import as DataFrame operators."""
