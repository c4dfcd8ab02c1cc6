"""Parameterised queries over record tables, planned lazily as Spark DataFrames."""
