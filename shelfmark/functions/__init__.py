"""Column builders; every one is a composition of built-in functions."""
