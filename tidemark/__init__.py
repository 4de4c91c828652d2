"""tidemark: an append-only time-series engine expressed on Spark DataFrames."""
