"""A Spark-native engine that searches and maintains catalogs of files and text."""
