"""Column functions: text cleaning, chunk windows, model-output parsing."""
