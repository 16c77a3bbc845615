"""Tidewater: a PySpark-native analytics engine for market panels and training-data pipelines."""
