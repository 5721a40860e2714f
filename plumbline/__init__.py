"""A Spark-native analytics engine for configuration compliance and corpus preparation."""
