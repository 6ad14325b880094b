"""Operators for preparing training data: text, vectors, pages and conversations."""
