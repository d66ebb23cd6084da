"""Column helpers; every one returns a native Spark expression."""
