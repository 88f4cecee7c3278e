"""larkspan: Spark-native detection, classification and scoring of labelled patterns in time series."""
