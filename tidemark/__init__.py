"""Tidemark: a Spark-native engine for time-gated cohort signals and record data."""

__version__ = "0.1.0"
