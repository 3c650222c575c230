"""Column expressions and driver-side mathematics."""
