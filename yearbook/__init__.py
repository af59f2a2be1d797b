"""Yearbook: a PySpark-native engine for longitudinal declaration data."""
