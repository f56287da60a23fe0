"""kindred: similarity retrieval and data preparation on Spark DataFrames."""
