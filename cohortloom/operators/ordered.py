"""Ranks, running sums and exact quantiles over a global order.

A window without a partition key puts a whole table into one task, and one partitioned by a few
labels puts a label's rows into one. Here the rows are range-partitioned by the sort key, each range
is summed, the sums of earlier ranges become an offset, and the running sum is taken within a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage, discard, small_side

# Merged rows that one range holds about; their number follows from the rows, not from a setting.
RANGE_ROWS = 500_000


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, str],
    by: Sequence[str] = (),
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` (source column to new column) along ``order``.

    With ``by``, sums restart per group. ``totals`` names columns for the sum of the whole group,
    which the sums of the ranges give for free. Rows with equal keys must have been merged before.
    """
    by, totals = list(by), totals or {}
    keys = [F.col(name) for name in by]
    # Counted, sampled for bounds and cut into ranges from one written copy.
    merged = cut_lineage(df, "merged")
    ranges = max(1, -(-merged.count() // RANGE_ROWS))
    # Range bounds are sampled anew on each run, so the range number is written down with the row.
    ranged = cut_lineage(
        merged.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    discard(merged)
    sources = sorted({*sums, *totals})
    range_sums = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sources])
    # One row per range, plus one per group that shares a range with another.
    whole = W.partitionBy(*by)
    earlier = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = range_sums.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(total) for c, total in totals.items()],
    )
    joined = ranged.join(small_side(offsets), [*by, "_range"])  # neither groups nor ranges are null
    inside = W.partitionBy(*by, "_range").orderBy(*order)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"_before_{c}")).alias(new) for c, new in sums.items()],
        *totals.values(),
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based row number over the whole table; the order must be total."""
    numbered = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_one": name})
    return numbered.drop("_one")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of some columns occurs, ``(metric, v, n)``; nulls do not count.

    Written down, since everything about the distributions is read off it: one scan of ``df`` serves all.
    """
    named = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns]
    values = df.select(F.inline(F.array(*named))).filter(F.col("v").isNotNull())
    return cut_lineage(values.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")


def moments_of(counts: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and deviation per metric of ``value_counts``."""
    total = F.sum("n")
    sums = counts.groupBy("metric").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), total.alias("_n"), (F.sum(F.col("v") * F.col("n")) / total).alias("mean")
    )
    off = F.col("v") - F.col("mean")
    squares = counts.join(sums, "metric").groupBy("metric").agg(F.sum(F.col("n") * off * off).alias("_s"))
    spare = F.when(F.col("_n") > 1, F.col("_n") - 1)
    return sums.join(squares, "metric").select("metric", "min", "max", "mean", F.sqrt(F.col("_s") / spare).alias("std"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], quantiles: Sequence[float]
) -> DataFrame:
    """Linearly interpolated quantiles: one row per column, one field ``q0, q1, ...`` per quantile."""
    return quantiles_of(value_counts(df, columns), quantiles)


def quantiles_of(counts: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Quantiles per metric of ``value_counts``.

    The quantile of position ``h = q * (n - 1)`` lies between the values at ranks ``floor(h)`` and
    ``ceil(h)``.
    """
    placed = running_sums(
        counts, [F.col("v").asc()], {"n": "upto"}, by=["metric"], totals={"n": "total"}
    )
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (last >= rank), F.col("v")))

    picks = []
    for i, q in enumerate(quantiles):
        h = F.lit(float(q)) * (F.col("total") - 1)
        picks += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
    found = placed.groupBy("metric").agg(F.first("total").alias("total"), *picks)
    out = []
    for i, q in enumerate(quantiles):
        h = F.lit(float(q)) * (F.col("total") - 1)
        share = h - F.floor(h)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * share).alias(f"q{i}"))
    return found.select("metric", *out)


def quantile_row(df: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of one column as one row with the given names."""
    found = exact_quantiles(df, [column], list(quantiles.values()))
    return found.select(*[F.col(f"q{i}").alias(name) for i, name in enumerate(quantiles)])
