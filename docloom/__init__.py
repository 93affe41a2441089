"""docloom: a PySpark-native documentation index, search and symbol-graph engine."""
