"""Transcript and document analytics on Spark DataFrames."""
