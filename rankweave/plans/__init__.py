"""Composite plans: the retrieval engine, evaluation, and the registered queries."""
