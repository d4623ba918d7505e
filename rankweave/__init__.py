"""Ranked retrieval over versioned text and code, and its evaluation, as lazy Spark plans."""
