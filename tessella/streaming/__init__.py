"""Event-time pipelines by Structured Streaming."""
