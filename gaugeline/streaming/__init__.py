"""Structured Streaming forms of scoring, ingest and the prediction store."""
