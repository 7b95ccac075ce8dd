"""Brindle: analytics over documents, tokens and activation vectors on Spark DataFrames."""
