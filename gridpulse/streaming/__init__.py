"""Structured Streaming: incremental staging upsert."""
