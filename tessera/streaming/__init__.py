"""Results that are read row by row."""
