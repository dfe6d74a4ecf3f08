"""Column and statistics building blocks."""
