"""Spark-native talent matching engine."""
