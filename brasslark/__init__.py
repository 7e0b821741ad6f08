"""Brasslark: a PySpark-native analytics engine for company data."""
