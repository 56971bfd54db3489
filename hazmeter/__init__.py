"""Change-risk analytics on Spark: coverage joined to functions, scored, banded and reported."""

__version__ = "0.1.0"
