"""Live variants on Structured Streaming."""
