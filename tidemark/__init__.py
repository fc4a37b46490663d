"""Deadline-ordered queue analytics as Spark DataFrames."""
