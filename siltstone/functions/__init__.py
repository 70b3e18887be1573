"""Column functions: text, globs, vectors, decoding."""
