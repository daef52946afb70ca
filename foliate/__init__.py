"""Documents, plans and retrieval as Spark DataFrame operations."""
