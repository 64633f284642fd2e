"""A PySpark-native engine for chronological ratings and corpus preparation."""
