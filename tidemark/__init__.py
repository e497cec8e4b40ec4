"""tidemark: bar-pattern analytics on Spark DataFrames."""
