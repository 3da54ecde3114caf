"""Column builders: every function returns a ``Column`` made of built-in expressions."""
