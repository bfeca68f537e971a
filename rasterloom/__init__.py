"""A Spark-native engine for time series of gridded scenes."""
