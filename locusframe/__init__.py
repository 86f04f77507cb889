"""A PySpark-native engine for sequencing-style genomics data."""
