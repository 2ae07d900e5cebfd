"""Spark-native reconciliation analytics: sources, functions, operators, plans and streams."""
