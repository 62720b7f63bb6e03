"""Structured Streaming jobs over the operational logs and incoming text."""
