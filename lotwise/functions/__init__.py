"""Column expressions; all of them stay in generated JVM code."""
