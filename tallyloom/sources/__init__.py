"""Readers of comment files, corpus packages, catalogues and contexts."""
