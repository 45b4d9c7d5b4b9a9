"""Table and model validation as Spark jobs: DataFrames in, DataFrames out."""
