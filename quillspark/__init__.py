"""Text-quality and fuzzy-matching analytics on Spark DataFrames."""
