"""Quillon: a PySpark-native engine for corpora of structured scientific documents."""
