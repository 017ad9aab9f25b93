"""Spark-native retrieval, ranking and curation engine for collections of short annotated texts."""

__version__ = "0.1.0"
