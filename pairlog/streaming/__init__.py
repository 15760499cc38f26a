"""Structured Streaming versions of the live scores."""
