"""longspan: longitudinal panel analytics on Spark DataFrames."""
