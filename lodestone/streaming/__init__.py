"""Streaming aggregations and incremental runs."""
