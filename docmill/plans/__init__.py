"""docmill.plans."""
