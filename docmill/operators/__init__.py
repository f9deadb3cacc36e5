"""docmill.operators."""
