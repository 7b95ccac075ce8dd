"""Structured Streaming forms of the incremental operators (section 2.10)."""
