"""Column expressions and array helpers shared by the operators."""
