"""Spark jobs for building and serving a document knowledge base."""
