"""Structured Streaming versions of ingest, counting and scoring."""
