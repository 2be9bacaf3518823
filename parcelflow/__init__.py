"""A Spark-native engine for reviewing administrative-boundary data."""
