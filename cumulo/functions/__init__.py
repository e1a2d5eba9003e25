"""Column functions: vectors and reproducible randomness."""
