"""Graph plans."""
