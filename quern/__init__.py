"""quern: a PySpark-native analytics engine for message, interaction and graph data."""
