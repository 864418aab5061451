"""The vitals feed as Structured Streaming."""
