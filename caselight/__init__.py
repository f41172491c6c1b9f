"""Caselight: a PySpark-native analytics engine for safety-case documents."""
