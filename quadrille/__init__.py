"""A PySpark-native engine for spatial extracts and wide-form tables."""
