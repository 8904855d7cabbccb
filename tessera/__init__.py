"""Spark-native analytics for annotated token and character sequences."""
