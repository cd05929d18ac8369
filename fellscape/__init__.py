"""fellscape: a Spark-first analytics engine for state-space landscapes."""

__version__ = "0.1.0"
