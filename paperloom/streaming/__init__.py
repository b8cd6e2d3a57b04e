"""Streaming of the page-retrieval engine."""
