"""Structured Streaming forms of tagging, de-duplication and volume counts."""
