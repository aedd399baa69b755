"""textlens: text-quality and domain-observation analytics on Spark DataFrames."""
