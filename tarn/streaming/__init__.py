"""Structured Streaming: watched directories."""
