"""gridspark: typed N-dimensional arrays, hierarchies and containers as Spark DataFrames."""

__version__ = "0.1.0"
