"""Time-to-event (survival) analytics on Spark DataFrames."""
