"""docengine: a PySpark-native document analytics engine."""
