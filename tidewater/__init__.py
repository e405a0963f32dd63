"""A Spark-native analytics engine: SQL front end, event analytics, views."""
