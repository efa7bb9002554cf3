"""Spark-native preparation and evaluation of question-answering data."""
