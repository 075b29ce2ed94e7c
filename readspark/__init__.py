"""A PySpark-native engine for sequencing reads and other symbol sequences."""
