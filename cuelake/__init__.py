"""A PySpark-native analytics engine for ordered, timestamped, noisy text."""
