"""Column expressions shared by the operators. No Python runs per row."""
