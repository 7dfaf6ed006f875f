"""pitlake: point-in-time-correct data engineering on PySpark."""

__version__ = "0.1.0"
