"""Readers of tabular, interval, annotation, variant and sequence files, as Spark DataFrames."""
