"""Spark-first analytics for match events, player tracking and detection tables."""
