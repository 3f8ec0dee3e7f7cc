"""Column expressions; all of them run inside Spark's generated code."""
