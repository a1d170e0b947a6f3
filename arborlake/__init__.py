"""Analytics and retrieval over research corpora, on Spark DataFrames."""
