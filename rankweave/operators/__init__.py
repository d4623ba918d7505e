"""Relational operators: index building, lexical and vector search, fusion, filters, reranking, metrics."""
