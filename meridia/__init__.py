"""Spark-native analytics for geospatial retrieval data: DataFrames in, DataFrames out."""
