"""Column expressions. Each one takes and returns Columns and stays inside code generation."""
