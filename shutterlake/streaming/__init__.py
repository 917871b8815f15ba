"""Structured Streaming forms of the activity, change, progress, ingest and match flows."""
