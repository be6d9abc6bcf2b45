"""Spark-native engine for multimodal transport networks."""
