"""Tidemark: a PySpark-native engine for geo-social influence queries."""
