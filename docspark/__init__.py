"""docspark: document analytics on Spark DataFrames."""
