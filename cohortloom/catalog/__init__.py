"""Registered queries over the given tables, each with independent SQL where SQL can say it."""

from cohortloom.catalog import (  # noqa: F401
    coverage,
    evaluation,
    labelling,
    learning,
    notes,
    profiling,
    scanning,
    storage,
)
from cohortloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
