"""PySpark-native analytics over coding-agent session histories."""

__version__ = "0.1.0"
