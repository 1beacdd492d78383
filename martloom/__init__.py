"""martloom: feature marts, evaluation and model jobs for tabular data on Spark."""

__version__ = "0.1.0"
