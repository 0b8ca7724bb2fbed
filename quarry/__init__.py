"""PySpark-native corpus search and analytics engine."""
