"""corvane: retrieval analytics and corpus processing on Spark DataFrames."""
