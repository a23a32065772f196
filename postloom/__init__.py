"""postloom: Spark transforms that turn posts into balanced, labeled training rows."""

__version__ = "0.1.0"
