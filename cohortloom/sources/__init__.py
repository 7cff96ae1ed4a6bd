"""Readers of raw tables and the Parquet stages between jobs."""
