"""Relational and graph operators over node, edge, element and run frames."""
