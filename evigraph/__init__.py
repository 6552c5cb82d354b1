"""Evidence-backed property graphs as Spark DataFrames."""
