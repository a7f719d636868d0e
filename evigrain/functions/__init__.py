"""Column builders and the few Arrow UDFs that native expressions can't replace."""
