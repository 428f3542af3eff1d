"""A Spark-first engine for code-graph facts and queries over them."""

__version__ = "0.1.0"
