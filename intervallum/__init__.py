"""Intervallum: knowledge-based temporal abstraction and record cleaning on Spark DataFrames."""

__version__ = "0.1.0"
