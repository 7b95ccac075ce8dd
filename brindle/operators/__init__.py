"""Operators over vectors, scores, tokens and result tables."""
