"""PySpark-native n-dimensional array analytics."""
