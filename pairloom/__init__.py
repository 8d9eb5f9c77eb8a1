"""A Spark-native engine for matched two-sided panels."""
