"""Column expressions (no Python UDFs)."""
