"""Operators for large-scale training-data pipelines (text, pages, vectors)."""
