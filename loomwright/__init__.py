"""loomwright: a Spark-first engine for preparing and understanding tabular data."""

__version__ = "0.1.0"
