"""Spark-native geometry, matching and evidence analytics."""
