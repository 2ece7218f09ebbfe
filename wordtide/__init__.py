"""Analytics over time-stamped text streams, on Spark DataFrames."""
