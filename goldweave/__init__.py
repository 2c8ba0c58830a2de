"""goldweave: entity resolution and sync deltas on Spark DataFrames."""
