"""Tradeloom: a market lakehouse and streaming engine made of Spark DataFrames."""
