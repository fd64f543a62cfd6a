"""Structured Streaming variants of the event-log operators."""
