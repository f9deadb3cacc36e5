"""docmill.sources."""
