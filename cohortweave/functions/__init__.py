"""Column expressions: text, checked values and pixel arrays."""
