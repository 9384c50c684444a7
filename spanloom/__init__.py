"""Spark-native analytics over span trees, with training-data operators in ``spanloom.llm``."""
