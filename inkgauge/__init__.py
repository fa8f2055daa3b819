"""Measuring and reviewing the text that several readers made of the same pages, on Spark DataFrames."""
