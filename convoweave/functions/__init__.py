"""Column functions: text, time and vectors."""
