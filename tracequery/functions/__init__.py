"""Column functions: pure expressions, with Arrow functions only where no expression is exact."""
