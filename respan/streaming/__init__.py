"""Incremental variants of batch operators (Structured Streaming, availableNow)."""
