"""siltmark: Spark-native curation, auditing and evaluation of labelled embedding datasets."""

__version__ = "0.1.0"
