"""Cleaning, profiling and reshaping of large text tables as plain Spark jobs."""
