"""Tessera: a small, strict SQL dialect and table store that runs on Spark DataFrames."""
