"""Column expressions used inside the table operators."""
