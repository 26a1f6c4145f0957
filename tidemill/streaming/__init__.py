"""The log, scoring and transform operators on Structured Streaming."""
