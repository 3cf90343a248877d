"""A PySpark-native engine for repeated structure in sequences."""
