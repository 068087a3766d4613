"""Forensic content analytics on Spark DataFrames."""
