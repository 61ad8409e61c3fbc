"""Alignment-free sequence-abundance analytics on Spark DataFrames."""
