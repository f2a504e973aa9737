"""functions of railweave."""
