"""Registered queries, and helpers of plans."""
