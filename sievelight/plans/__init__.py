"""plans of the scan jobs."""
