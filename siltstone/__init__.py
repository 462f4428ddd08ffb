"""A PySpark-native engine for document retrieval, evaluation and training-data preparation."""
