"""Spark-native analytics for sparse multiband light curves."""
