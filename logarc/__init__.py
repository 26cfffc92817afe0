"""Spark-native archive for logs: templates, typed variables, dictionaries."""
