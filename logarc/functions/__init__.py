"""Column-to-column functions: all of them plain Catalyst expressions."""
