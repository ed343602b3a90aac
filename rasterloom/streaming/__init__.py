"""Structured Streaming jobs: chip ingest checks, metric windows, embedding upserts."""
