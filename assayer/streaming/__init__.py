"""Structured Streaming use of the row-local rules."""
