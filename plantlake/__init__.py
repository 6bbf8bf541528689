"""Spark-native analytics for plant time series, plant event logs and document retrieval."""
