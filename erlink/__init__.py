"""erlink: a PySpark-native entity-resolution and corpus analytics engine."""
