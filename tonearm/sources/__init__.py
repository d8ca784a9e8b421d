"""Sources of the library engine."""
