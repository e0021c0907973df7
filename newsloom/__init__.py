"""Spark operators for building and analysing a news-article corpus."""

__version__ = "0.1.0"
