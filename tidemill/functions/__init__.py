"""Column functions; every one is an expression over Spark built-ins."""
