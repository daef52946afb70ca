"""Structured Streaming versions of the counters and of the status machine."""
