"""Strandline: a Spark-native engine for ingesting and querying text corpora."""
