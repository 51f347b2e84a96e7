"""Column expressions, special functions and distributed order statistics."""
