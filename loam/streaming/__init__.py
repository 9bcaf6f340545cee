"""The user view over a growing log, by Structured Streaming."""
