"""Column functions and small per-row helpers."""
