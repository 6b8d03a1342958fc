"""Structured Streaming on top of the batch operators."""
