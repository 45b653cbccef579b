"""Spark-native analysis of event logs from test runs."""
