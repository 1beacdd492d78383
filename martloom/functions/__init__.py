"""Column expressions: Column in, Column out, no job is run."""
