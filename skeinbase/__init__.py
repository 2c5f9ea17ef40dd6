"""Skeinbase: a PySpark-native knowledge-graph retrieval engine."""
