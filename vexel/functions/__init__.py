"""Column functions on vectors, and their SQL registration."""
