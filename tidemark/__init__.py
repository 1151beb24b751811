"""Part of tidemark, a PySpark-native panel analytics engine."""
