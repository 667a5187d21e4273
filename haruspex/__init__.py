"""Uncertainty quantification and structural reliability on Spark DataFrames."""
