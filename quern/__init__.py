"""A Spark-native engine for ranked retrieval over catalogued text corpora."""
