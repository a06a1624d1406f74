"""functions of the scan jobs."""
