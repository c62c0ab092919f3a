"""Tick analytics on Spark: exact summaries, bars and flow over ordered market ticks."""

__version__ = "0.1.0"
