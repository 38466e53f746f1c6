"""docdrift - snapshot diffing and document maintenance as Spark DataFrame plans."""

__version__ = "0.1.0"
