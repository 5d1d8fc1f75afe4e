"""A PySpark-native engine for historical knowledge graphs."""
