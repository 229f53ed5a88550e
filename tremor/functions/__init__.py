"""Column expressions and Arrow UDFs."""
