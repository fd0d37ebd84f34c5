"""Column expressions that make dirty strings, amounts and dates comparable."""
