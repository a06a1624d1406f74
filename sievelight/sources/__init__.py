"""sources of the scan jobs."""
