"""Structured Streaming queries: counting, totals, change feed, quarantine."""
