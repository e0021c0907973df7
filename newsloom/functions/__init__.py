"""Column -> Column building blocks; native Spark expressions only."""
