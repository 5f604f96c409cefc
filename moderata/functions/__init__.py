"""Column expressions; all of them are Spark built-ins composed, no Python UDFs."""
