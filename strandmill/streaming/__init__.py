"""Directory streams and the load queue."""
