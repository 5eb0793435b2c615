"""Spoken-form text normalization and corpus preparation on Spark DataFrames."""
