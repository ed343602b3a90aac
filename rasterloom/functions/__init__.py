"""Column expressions: draws, encodings, pixel arithmetic, vectors, geometry."""
