"""Structured Streaming members (an extension: the graph operators themselves are batch)."""
