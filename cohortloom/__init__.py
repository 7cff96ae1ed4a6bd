"""Cohort building, text curation and multi-label analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
