"""blockloom: a PySpark-native engine for urban-block morphometrics."""
