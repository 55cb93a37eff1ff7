"""A Spark-native engine over mail archives."""
