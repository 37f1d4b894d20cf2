"""Spark-native engine for fact graphs, rules, constraints and retrieval."""
