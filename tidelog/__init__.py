"""Analytics over append-only, time-ordered event logs, on Spark DataFrames."""
