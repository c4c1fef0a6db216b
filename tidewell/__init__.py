"""Session-reuse analytics on Spark: DataFrames in, DataFrames out."""
