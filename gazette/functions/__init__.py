"""Column expressions (F1-F16) shared by every operator."""
