"""Listing search and ranking as Spark DataFrame jobs."""
