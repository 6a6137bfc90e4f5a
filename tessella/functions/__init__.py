"""Column functions that Spark SQL lacks."""
