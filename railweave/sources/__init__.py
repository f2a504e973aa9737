"""sources of railweave."""
