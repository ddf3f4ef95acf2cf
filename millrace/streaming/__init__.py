"""Structured Streaming: change logs, incremental views, event-time windows."""
