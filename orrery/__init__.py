"""Orrery: a Spark-first world-model, correlation and projection engine."""

__version__ = "0.1.0"
