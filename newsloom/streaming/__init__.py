"""Structured Streaming forms of ingestion and deduplication."""
