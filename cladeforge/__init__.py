"""Spark-native minimizer / lowest-common-ancestor sequence analytics."""
