"""Fitted plans on Structured Streaming input."""
