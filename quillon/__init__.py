"""Typed tables and quality reports from batches of business documents, on Spark DataFrames."""
