"""reviewloom: a PySpark-native engine for review spreadsheets and their analysis."""

__version__ = "0.1.0"
