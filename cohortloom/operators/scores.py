"""Scores next to truth.

Two shapes carry the same cells. The *long* one has a row per document and label:
``(hadm_id, icd_code, prob, y)``. The *wide* one has a row per document with
``cells array<struct<icd_code, prob, y>>``; it is what a model emits, joins truth with one shuffle per
document instead of one per cell, and unfolds to the long shape without any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import small_side

KEY = "hadm_id"


def pack_scores(predictions: DataFrame) -> DataFrame:
    """Long predictions to one row per document."""
    cells = F.array_sort(F.collect_list(F.struct("icd_code", "prob")))
    return predictions.groupBy(KEY).agg(cells.alias("scores"))


def align_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Wide scores with truth; a cell without a truth row is 0."""
    positives = truth.groupBy(KEY).agg(F.collect_set("icd_code").alias("_on"))
    joined = scores.join(positives, KEY, "left")
    on = F.coalesce("_on", F.array().cast("array<string>"))
    cells = F.transform(
        "scores",
        lambda s: F.struct(
            s["icd_code"].alias("icd_code"),
            s["prob"].alias("prob"),
            F.array_contains(on, s["icd_code"]).cast("int").alias("y"),
        ),
    )
    return joined.select(KEY, cells.alias("cells"))


def long_scores(wide: DataFrame) -> DataFrame:
    """Wide cells as one row each."""
    return wide.select(KEY, F.inline("cells"))


def join_pred_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Long predictions with truth, by one shuffle of documents rather than of cells."""
    return long_scores(align_scores(pack_scores(predictions), truth))


def with_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Long cells with the threshold of their label and the 0/1 prediction.

    A label without a threshold cannot be decided and fails the job.
    """
    small = small_side(thresholds.select("icd_code", "threshold"))
    joined = scored.join(small, "icd_code", "left")
    missing = F.raise_error(F.concat(F.lit("no threshold for label "), F.coalesce("icd_code", F.lit("null"))))
    given = F.coalesce("threshold", missing.cast("double"))
    return joined.withColumn("threshold", given).withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("int"))


def threshold_predict(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``prob >= threshold`` of the label as 0/1."""
    return with_thresholds(predictions, thresholds).select(KEY, "icd_code", "prob", "pred")


def score_documents(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Codes by falling score, their scores, and the codes that reach their threshold.

    The thresholds are a small dictionary, so the same expression serves batch and stream.
    """
    cut = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    ordered = F.array_sort(
        F.transform(
            "scores",
            lambda s: F.struct(
                (-s["prob"]).alias("minus"), s["icd_code"].alias("icd_code"), s["prob"].alias("prob")
            ),
        )
    )
    passed = F.filter("_ordered", lambda s: s["prob"] >= F.try_element_at(cut, s["icd_code"]))
    kept = [c for c in scores.columns if c != "scores"]
    return scores.select(*kept, ordered.alias("_ordered")).select(
        *kept,
        F.col("_ordered.icd_code").alias("codes"),
        F.col("_ordered.prob").alias("scores"),
        F.transform(passed, lambda s: s["icd_code"]).alias("thresholded"),
    )


def threshold_map(thresholds: DataFrame, limit: int = 1000) -> dict[str, float]:
    """The thresholds of at most ``limit`` labels as a dictionary."""
    rows = thresholds.select("icd_code", "threshold").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    return {row.icd_code: row.threshold for row in rows}
