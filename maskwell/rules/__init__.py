"""Detection rules as data: patterns, needed words and acceptance expressions."""
