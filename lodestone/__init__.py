"""Retrieval, relation and rule-evaluation analytics on Spark DataFrames."""
