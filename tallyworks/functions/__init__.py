"""Column functions and distribution functions."""
