"""Spark-native opponent-adjusted rating engine."""
