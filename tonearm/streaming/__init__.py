"""Streaming of the library engine."""
