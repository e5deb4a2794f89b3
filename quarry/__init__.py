"""Document analytics and evidence retrieval on Spark DataFrames."""
