"""operators of railweave."""
