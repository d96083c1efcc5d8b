"""Structured Streaming: ingest and subscriptions."""
