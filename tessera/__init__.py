"""tessera: a PySpark-native similarity-analytics engine."""
