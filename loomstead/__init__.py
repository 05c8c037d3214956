"""Retrieval, findings and text analytics as lazy DataFrame functions."""
