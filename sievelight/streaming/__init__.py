"""streaming of the scan jobs."""
