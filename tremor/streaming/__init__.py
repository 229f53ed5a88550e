"""Structured Streaming jobs: drop-directory ingest."""
