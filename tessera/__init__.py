"""Spark-first analytics for cross-sectional panels (see README.md)."""
