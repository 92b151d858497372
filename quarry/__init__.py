"""A PySpark-native retrieval and document-analytics engine."""
