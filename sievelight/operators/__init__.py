"""operators of the scan jobs."""
