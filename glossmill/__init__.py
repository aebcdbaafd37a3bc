"""Spark-native meaning ranking, content selection and corpus processing."""
