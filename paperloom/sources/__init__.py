"""Readers and writers of page corpora, logs and reports."""
