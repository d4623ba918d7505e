"""Operators for preparing training corpora at scale, and the queries that apply them.

Nothing outside this subpackage imports it.
"""
