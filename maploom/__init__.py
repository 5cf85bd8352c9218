"""Spark-native analytics for temporal map features and image-derived geometry."""
