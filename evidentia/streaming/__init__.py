"""Streams of changes into the store."""
