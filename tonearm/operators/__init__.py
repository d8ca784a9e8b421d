"""Operators of the library engine."""
