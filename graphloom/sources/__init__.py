"""Scans of working copies, envelopes of extracted facts, settings files and sinks."""
