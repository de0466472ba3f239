"""Spark-native kernels for sorting, graphs, matrices and run reports."""
