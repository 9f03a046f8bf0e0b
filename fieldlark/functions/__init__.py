"""Column expressions: text, numbers, angles, grid, vectors."""
