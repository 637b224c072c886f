"""Structured Streaming forms of ingest, landing, freshness, windows and claims."""
