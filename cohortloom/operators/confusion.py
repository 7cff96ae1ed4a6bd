"""Error analysis: which labels are taken for which, and the per-label report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.codes import default_description
from cohortloom.functions.numbers import safe_ratio
from cohortloom.operators.curate import dedup_dictionary
from cohortloom.operators.labels import index_tiles, label_grid, pair_counts
from cohortloom.operators.metrics import brier_per_label, per_label_metrics
from cohortloom.operators.tables import top
from cohortloom.session import small_side


def substitution_counts(
    wide: DataFrame, thresholds: dict[str, float], names: list[str]
) -> DataFrame:
    """Documents where ``true_code`` holds and ``wrong_code`` is a false positive.

    Both sets are read off the row of a document as tiles of bits, so no pairs of cells are joined.
    """
    cut = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    codes = F.array(*[F.lit(c) for c in names])

    def places(test):
        hit = F.filter("cells", test)
        return F.transform(hit, lambda c: F.array_position(codes, c["icd_code"]).cast("int") - 1)

    true = places(lambda c: c["y"] == 1)
    wrong = places(
        lambda c: (c["y"] == 0) & (c["prob"] >= F.try_element_at(cut, c["icd_code"]))
    )
    sets = wide.select(index_tiles(true, len(names)).alias("true"), index_tiles(wrong, len(names)).alias("wrong"))
    pairs = pair_counts(sets, F.col("true"), F.col("wrong"), names)
    return pairs.select(F.col("a").alias("true_code"), F.col("b").alias("wrong_code"), F.col("n").alias("count"))


def confusion_pairs(
    counts: DataFrame,
    support: DataFrame,
    dictionary: DataFrame | None = None,
    top_n: int = 10,
    version: int = 10,
) -> DataFrame:
    """The most frequent substitutions with titles and their rate among the true cases.

    ``support`` holds ``(icd_code, support)``.
    """
    found = counts.filter((F.col("count") > 0) & (F.col("true_code") != F.col("wrong_code")))
    first = top(found, [F.desc("count"), F.col("true_code"), F.col("wrong_code")], top_n)
    rows = first.join(
        small_side(support.select(F.col("icd_code").alias("true_code"), F.col("support").alias("true_support"))),
        "true_code",
    ).withColumn("rate_per_true", safe_ratio(F.col("count"), F.col("true_support")))
    if dictionary is None:
        return rows
    # top_n rows look their titles up; the dictionary is not shuffled for them
    titles = dedup_dictionary(dictionary, version)
    for side in ("true", "wrong"):
        named = titles.select(
            F.col("icd_code").alias(f"{side}_code"), F.col("long_title").alias(f"_{side}")
        )
        rows = rows.join(named, f"{side}_code", "left").withColumn(
            f"{side}_desc", default_description(F.col(f"_{side}"))
        )
    return rows.drop("_true", "_wrong")


def most_confused_labels(counts: DataFrame, n: int = 10) -> DataFrame:
    """Labels most involved in substitutions, on either side."""
    off = counts.filter(F.col("true_code") != F.col("wrong_code"))
    ends = F.array(F.col("true_code"), F.col("wrong_code"))
    involved = off.select(F.explode(ends).alias("icd_code"), "count")
    totals = involved.groupBy("icd_code").agg(F.sum("count").alias("involvement"))
    return top(totals, [F.desc("involvement"), F.col("icd_code")], n)


def confusion_submatrix(counts: DataFrame, n: int = 10) -> DataFrame:
    """Substitutions among the most confused labels; the diagonal is 0."""
    chosen = small_side(most_confused_labels(counts, n).select("icd_code"))
    kept = counts.join(chosen.withColumnRenamed("icd_code", "true_code"), "true_code", "left_semi")
    kept = kept.join(chosen.withColumnRenamed("icd_code", "wrong_code"), "wrong_code", "left_semi")
    same = F.col("true_code") == F.col("wrong_code")
    value = F.when(same, F.lit(0).cast("bigint")).otherwise(F.col("count"))
    return kept.select("true_code", "wrong_code", value.alias("count"))


def confusion_grid(submatrix: DataFrame, names: list[str]) -> DataFrame:
    """The sub-matrix as a square table."""
    return label_grid(submatrix, names, "true_code", "wrong_code", "count")


def per_label_report(
    scored: DataFrame, thresholds: DataFrame, dictionary: DataFrame | None, version: int = 10
) -> DataFrame:
    """Per-label metrics with title and Brier score."""
    metrics = per_label_metrics(scored, thresholds).join(brier_per_label(scored), "icd_code")
    if dictionary is None:
        title = default_description(F.lit(None).cast("string"))
        return metrics.withColumn("description", title)
    titles = dedup_dictionary(dictionary, version)
    named = metrics.join(titles, "icd_code", "left")
    return named.withColumn("description", default_description(F.col("long_title"))).drop("long_title")


def worst_labels(per_label: DataFrame, n: int = 10) -> DataFrame:
    return top(per_label, [F.col("f1"), F.col("icd_code")], n)


def best_labels(per_label: DataFrame, n: int = 10) -> DataFrame:
    return top(per_label, [F.desc("f1"), F.col("icd_code")], n)
