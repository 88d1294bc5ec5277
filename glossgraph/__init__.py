"""Corpus semantics on Spark: text graphs, category mappings and coverage as DataFrames."""
