"""wardflow: entity-level risk pipelines over long-format readings, on Spark."""

__version__ = "0.1.0"
