"""tablescribe: describe, search and sample large collections of tables on Spark."""

__version__ = "0.1.0"
