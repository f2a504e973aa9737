"""streaming of railweave."""
