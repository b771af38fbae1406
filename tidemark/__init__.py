"""Spark-native context retrieval: catalogue ingest, ranking, path graphs and evaluation."""
