"""Sessions as a Structured Streaming job."""
