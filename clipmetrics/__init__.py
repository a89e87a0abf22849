"""PySpark-native analytics for short-video discovery, job history and captions."""

__version__ = "0.1.0"
