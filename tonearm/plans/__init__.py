"""Plans of the library engine."""
