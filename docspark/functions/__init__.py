"""Column expressions: text, numbers, validators of fields."""
