"""Structured Streaming counterparts of the batch ingest."""
