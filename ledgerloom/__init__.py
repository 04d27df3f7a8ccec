"""A PySpark-native engine to understand, compare, transform and move tabular data."""
