"""Spark-native property-graph and corpus analytics."""
