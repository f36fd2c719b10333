"""chartloom: a PySpark-native engine for longitudinal records, retrieval and evaluation."""

__version__ = "0.1.0"
