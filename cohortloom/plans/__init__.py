"""Whole jobs: stages joined by Parquet tables, the profiling report and the error analysis."""
