"""Readers and writers of documents, chunks, templates and results."""
