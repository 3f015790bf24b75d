"""Column builders; every one is a stateless Spark expression."""
