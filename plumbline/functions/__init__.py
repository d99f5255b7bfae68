"""Column expressions, rule chains and fixed values shared by the operators."""
