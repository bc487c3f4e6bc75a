"""Column expressions: text, time, numbers, sentiment."""
