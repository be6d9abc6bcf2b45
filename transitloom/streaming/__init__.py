"""Structured Streaming variants of link statistics, beyond the batch engine."""
