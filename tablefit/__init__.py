"""Clean untyped tables, build features and fit price-like regressors on Spark."""
