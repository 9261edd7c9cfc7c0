"""Spark-native sequence analytics: segments, runs, interval joins, candidate selection and their sources and sinks."""
