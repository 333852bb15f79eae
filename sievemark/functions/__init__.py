"""Column functions and fixed rule values."""
