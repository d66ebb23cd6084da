"""Structured Streaming runs of the same jobs."""
