"""Strandline: a Spark-native engine that assigns sequences to nodes of a taxonomy."""
