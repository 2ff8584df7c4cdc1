"""Composed plans: the ingest pipeline, and the catalogue of registered queries."""
