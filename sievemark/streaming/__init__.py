"""Structured Streaming forms of the stateful checks."""
