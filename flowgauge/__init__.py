"""Spark-native scoring of procedural knowledge extracted from flowchart pages."""
