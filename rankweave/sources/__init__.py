"""Readers, writers and their validation; chunking of source files."""
