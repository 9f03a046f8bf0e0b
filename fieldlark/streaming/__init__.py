"""Structured Streaming twins of the event-like behaviour."""
