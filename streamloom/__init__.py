"""A Spark-native engine for packet streams, codestream structure and training text."""
