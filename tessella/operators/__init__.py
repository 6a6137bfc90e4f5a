"""Operators on labelled tables: long cells (one row for each entry) or plain rows, always DataFrame in, DataFrame out."""
