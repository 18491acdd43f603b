"""Streams: change feed, versions, rate limits."""
