"""Streaming and nightly jobs."""
