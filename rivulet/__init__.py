"""A PySpark-native engine for continuous queries over event data."""
