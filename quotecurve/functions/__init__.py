"""Column expressions: Column in, Column out, no jobs."""
