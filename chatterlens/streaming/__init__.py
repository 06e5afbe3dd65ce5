"""Structured Streaming jobs over comments."""
