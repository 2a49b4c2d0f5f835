"""Retrieval analytics over text corpora as DataFrame jobs."""
