"""A document knowledge base and its retrieval engine, written as Spark DataFrame jobs."""
