"""Analytics over logs, traces, metrics and model calls as plain Spark DataFrames."""
