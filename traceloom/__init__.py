"""Spark-native analytics over agent session logs and training corpora."""
