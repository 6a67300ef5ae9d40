"""Spark-native fusion of uncertain observations into queryable canonical records."""
