"""Layered-snapshot deduplication on Spark."""
