"""nacre: macromolecular interface analytics as DataFrame pipelines on PySpark."""

__version__ = "0.1.0"
