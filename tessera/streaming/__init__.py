"""Structured Streaming: status of documents, windows of transcripts, chat memory. Each has a batch twin with the same results."""
