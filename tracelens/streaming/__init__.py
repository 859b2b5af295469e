"""Structured Streaming: ingestion of session events, keyed state, and session windows."""
