"""A Spark-first engine for linear systems, least squares and eigenvalues over tables."""
