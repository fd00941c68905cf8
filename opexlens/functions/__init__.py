"""Column expressions shared by the operators (numbers, dates, categories,
names, guarded ratios)."""
