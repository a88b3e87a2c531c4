"""Analytics over time-annotated, speaker-attributed events, on Spark DataFrames."""
