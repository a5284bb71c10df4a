"""Fund knowledge-graph analytics on Spark DataFrames."""
