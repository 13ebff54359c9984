"""Column expressions, statistics joins, tile windows and run-time helpers."""
