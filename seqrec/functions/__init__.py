"""Column functions: arrays, vectors, text and time."""
