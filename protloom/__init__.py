"""Protein k-mer sketching and search on Spark DataFrames."""
