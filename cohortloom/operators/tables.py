"""Small shapes shared by the report operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, name: str, value: str, cells: dict[str, Column]) -> DataFrame:
    """Turn columns of each row into ``(name, value)`` rows, one per cell."""
    pairs = [F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in cells.items()]
    return df.select(F.inline(F.array(*pairs)))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expression is dear, e.g. a regular expression over a long text.

    The optimizer pastes the expression of a plain column into every filter above it, which then
    computes it again. It does not see through a generator, so these are the output of one.
    """
    cell = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(cell)))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys; merged before the shuffle, so a hot key costs one row per task."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def restrict(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs among ``keys``."""
    return df.join(distinct_keys(keys, key), key, "left_semi")


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order: every task keeps ``n`` rows, no full sort."""
    return df.orderBy(*order).limit(n)
