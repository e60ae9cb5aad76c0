"""strataframe: snapshot evidence analytics on Spark DataFrames."""
