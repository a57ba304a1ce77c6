"""alphaloom: quantitative-finance analytics on Spark DataFrames."""
