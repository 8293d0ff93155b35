"""Online training over Structured Streaming."""
