"""Spark jobs for document processing, retrieval analytics and training-data preparation."""
