"""Spark-native mining of recurring patterns in ordered series."""
