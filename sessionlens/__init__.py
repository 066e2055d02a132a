"""Spark-native network-flow session analytics."""
