"""Structured Streaming jobs built on the batch operators."""
