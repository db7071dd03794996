"""Column expressions and the small numeric helpers behind p-values."""
