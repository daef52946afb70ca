"""Operators on DataFrames of blocks, chunks, graphs, statuses and messages."""
