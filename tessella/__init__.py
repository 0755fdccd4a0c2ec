"""Spark-native analytics over descriptors, rankings, maps and text corpora."""
