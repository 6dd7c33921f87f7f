"""Analytics of aligned symbol sequences, and of the rankings computed from them, on Spark."""
