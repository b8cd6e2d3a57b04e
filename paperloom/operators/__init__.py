"""Operators of the page-retrieval engine."""
