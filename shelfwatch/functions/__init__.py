"""Column functions: rounding, stock formulas, classification and sentences."""
