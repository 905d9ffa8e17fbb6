"""Structured Streaming forms of the event counts."""
