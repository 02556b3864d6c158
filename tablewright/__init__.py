"""Tablewright: profiling, preparation, modelling and retrieval over Spark tables."""

__version__ = "0.1.0"
