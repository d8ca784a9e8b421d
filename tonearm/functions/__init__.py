"""Functions of the library engine."""
