"""A PySpark-native analytics engine for language-model output data."""
