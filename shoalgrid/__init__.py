"""shoalgrid: a PySpark-native analytics engine for gridded observations and time series."""
