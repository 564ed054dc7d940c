"""Change points in keyed time series, and the bookkeeping around them, on Spark DataFrames."""
