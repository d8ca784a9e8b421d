"""Writers of the library engine."""
