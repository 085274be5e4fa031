"""Spark-native geospatial event, trajectory and corpus analytics."""
