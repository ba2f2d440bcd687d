"""Audit crawled pages against expected content, as Spark DataFrame jobs."""

__version__ = "0.1.0"
