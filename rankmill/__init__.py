"""Rankmill: batch hybrid retrieval, ranking and corpus preparation on Spark DataFrames."""
