"""Trust-boundary analytics over CI/CD workflow tables, planned as Spark DataFrames."""
