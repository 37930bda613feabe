"""Sensitive-data scanning and training-data preparation on Apache Spark."""
