"""Spark-native record linkage and text analytics."""
