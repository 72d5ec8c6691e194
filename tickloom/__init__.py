"""Event-log analytics and corpus preparation as Spark DataFrame transforms."""

__version__ = "0.1.0"
