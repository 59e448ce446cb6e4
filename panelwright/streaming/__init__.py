"""Structured Streaming forms of the loaders."""
