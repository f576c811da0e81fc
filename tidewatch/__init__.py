"""Spark-native campaign analytics over hourly flow records."""
