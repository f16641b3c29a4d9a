"""The hourly loop as Structured Streaming jobs."""
