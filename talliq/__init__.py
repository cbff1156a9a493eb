"""talliq: a PySpark-native engine for token-usage ledgers."""
