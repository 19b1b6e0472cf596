"""A PySpark-native engine for ranked retrieval, its evaluation and text-corpus preparation."""
