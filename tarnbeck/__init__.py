"""tarnbeck: a PySpark-native batch analytics engine."""
