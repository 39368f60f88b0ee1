"""Spark-native analytics over time-stamped conversations and sound-event timelines."""

__version__ = "0.1.0"
