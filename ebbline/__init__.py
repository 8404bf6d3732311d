"""Spark-native screening, fall decomposition, walk-forward measurement and private-raise filtering."""
