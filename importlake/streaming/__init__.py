"""Incremental ingest and counts with Structured Streaming."""
