"""Spark-native analytics over multi-station time series and the events in them."""
