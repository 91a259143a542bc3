"""Cascadia: batch analytics on Spark DataFrames for grid risk and text corpora."""
