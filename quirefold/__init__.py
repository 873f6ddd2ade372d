"""Quirefold: a Spark-first engine for resumable document-corpus conversion."""
