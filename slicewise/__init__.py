"""Spark-native RAN-slice KPI analytics."""
