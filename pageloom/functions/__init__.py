"""Column functions: geometry, text, decoding."""
