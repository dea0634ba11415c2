"""Statistical features of series."""
