"""Tessella: labelled tables and matrices as Spark DataFrames, with declarative operators over them."""
