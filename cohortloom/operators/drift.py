"""Population stability of a table of binned features against a reference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import small_side

# Share that stands for an empty bin, so that its logarithm exists.
EMPTY_SHARE = 1e-6

# Edges of the token-length bins; the last bin is open.
TOKEN_EDGES = (0, 64, 128, 256, 512, 1024, 2048, 4096)


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of the last edge a value reaches, from 0; -1 below the first."""
    return reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges]) - 1


def score_bin(prob: Column) -> Column:
    """Decile of a probability; 1.0 falls into the last."""
    return F.least(F.floor(prob * 10), F.lit(9)).cast("int")


def binned(df: DataFrame, period: Column, feature: str, bin_of: Column) -> DataFrame:
    """Rows ``(period, feature, bin, n)``."""
    marked = df.select(
        period.alias("period"), F.lit(feature).alias("feature"), bin_of.cast("string").alias("bin")
    )
    return marked.groupBy("period", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def drift_report(
    counts: DataFrame, reference: str = "reference", current: str = "current"
) -> DataFrame:
    """Stability index per feature: sum over bins of (c - r) * ln(c / r) of the bin shares.

    ``counts`` holds the merged ``(period, feature, bin, n)`` rows of both periods.
    """
    side = {
        "r": F.sum(F.when(F.col("period") == reference, F.col("n")).otherwise(0)),
        "c": F.sum(F.when(F.col("period") == current, F.col("n")).otherwise(0)),
    }
    bins = counts.groupBy("feature", "bin").agg(*[v.alias(k) for k, v in side.items()])
    totals = bins.groupBy("feature").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    shares = bins.join(small_side(totals), "feature").select(
        "feature",
        F.greatest(F.col("r") / F.greatest("rt", F.lit(1)), F.lit(EMPTY_SHARE)).alias("r"),
        F.greatest(F.col("c") / F.greatest("ct", F.lit(1)), F.lit(EMPTY_SHARE)).alias("c"),
    )
    term = (F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))
    return shares.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum(term).alias("psi")
    )
