"""Column expressions over tuples."""
