"""Column expressions that Spark has no single built-in for."""
