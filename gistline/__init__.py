"""gistline: extractive text compression and corpus processing on Spark DataFrames."""
