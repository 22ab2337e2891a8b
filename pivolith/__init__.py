"""A PySpark-native pivot and analytics engine."""
