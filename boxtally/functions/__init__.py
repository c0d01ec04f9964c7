"""Column functions: geometry, probabilities, text, hashing."""
