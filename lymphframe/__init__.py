"""lymphframe: a Spark-first analytics engine for cell, signature and cluster data."""

__version__ = "0.1.0"
