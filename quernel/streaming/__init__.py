"""Background work as Structured Streaming."""
