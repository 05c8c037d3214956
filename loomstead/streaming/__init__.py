"""Structured Streaming over retrieval logs and file states."""
