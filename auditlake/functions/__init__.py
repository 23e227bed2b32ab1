"""Column functions and helpers that several operators share."""
