"""Quarry: a PySpark-native analytics engine with random-sample block storage."""
