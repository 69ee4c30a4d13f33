"""Sequence-read filtering and text preparation on Spark."""

__version__ = "0.1.0"
