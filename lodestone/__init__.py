"""Lodestone: a PySpark-native analytics library for feature tables and text corpora."""
