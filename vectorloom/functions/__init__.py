"""Column expressions and driver-side numerics."""
