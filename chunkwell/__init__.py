"""Spark-first engine for document corpora: ingestion, retrieval and data processing as DataFrame plans."""
