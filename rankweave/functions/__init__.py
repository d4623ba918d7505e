"""Column-valued functions: text, query understanding, versions."""
