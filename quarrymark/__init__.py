"""Spark-native retrieval, evidence and event-stream analytics."""
