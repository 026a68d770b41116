"""A Spark-native engine for code-and-data corpora."""
