"""A Spark-native engine for querying, mining and rewriting ordered labelled trees."""
