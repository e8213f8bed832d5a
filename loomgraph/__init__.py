"""Spark-native idea-graph analytics: documents become ideas, ideas become a typed graph."""
