"""Column functions: keys, text, classification."""
