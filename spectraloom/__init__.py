"""A Spark-native engine for searching mass spectra, vectors and hit tables."""

__version__ = "0.1.0"
