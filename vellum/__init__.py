"""A PySpark-native engine for querying and transforming collections of word-processing documents."""
