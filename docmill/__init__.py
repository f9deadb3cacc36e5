"""docmill: a Spark-first document knowledge base and retrieval engine."""
