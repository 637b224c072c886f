"""Column functions: every one returns a Column and stays inside generated code."""
