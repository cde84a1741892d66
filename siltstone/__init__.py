"""A Spark-native medallion analytics engine."""
