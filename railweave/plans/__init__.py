"""plans of railweave."""
