"""Column functions: missing values and reproducible random draws."""
