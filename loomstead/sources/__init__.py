"""Readers, parsers of text tables, and sinks."""
