"""docframe: document analytics as Spark relations."""

__version__ = "0.1.0"
