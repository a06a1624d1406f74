"""Rule tables that come with the library; others are read from JSON."""
