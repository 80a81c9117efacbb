"""Structured Streaming variants of the incremental parts."""
