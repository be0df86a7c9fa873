"""trackloom: catalogue search, recommendation and data preparation as plain Spark DataFrame plans."""

__version__ = "0.1.0"
