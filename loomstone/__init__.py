"""loomstone: analytics and corpus processing over ordered text, written for Spark DataFrames."""
