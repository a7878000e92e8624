"""Streams of changes kept as state."""
