"""Deduplication analytics on Spark: values, references and similarity as DataFrames."""
