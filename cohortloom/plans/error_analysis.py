"""Error analysis of the saved model on the test part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import confusion as cf
from cohortloom.operators import metrics as mx
from cohortloom.operators.labels import label_list
from cohortloom.operators.scores import long_scores, threshold_map
from cohortloom.plans.stages import score_split
from cohortloom.sources import stages as st
from cohortloom.sources.raw import path_exists
from cohortloom.sources.stages import StagePaths, read_stage, write_stage


def error_tables(
    wide: DataFrame,
    thresholds: DataFrame,
    names: list[str],
    dictionary: DataFrame | None = None,
    top_n: int = 10,
) -> dict[str, DataFrame]:
    """Every table of the report, by name."""
    scored = long_scores(wide)
    per_label = cf.per_label_report(scored, thresholds, dictionary)
    counts = cf.substitution_counts(wide, threshold_map(thresholds), names)
    support = scored.groupBy("icd_code").agg(F.sum("y").alias("support"))
    return {
        "per_label": per_label,
        "confusion_pairs": cf.confusion_pairs(counts, support, dictionary, top_n),
        "confusion_submatrix": cf.confusion_submatrix(counts),
        "reliability": mx.reliability_curve(scored),
        "macro_brier": mx.macro_brier(scored),
        "summary": mx.prediction_summary(scored, thresholds),
        "threshold_summary": mx.threshold_summary(thresholds),
        "worst_labels": cf.worst_labels(per_label),
        "best_labels": cf.best_labels(per_label),
    }


def run_error_analysis(spark: SparkSession, stages: StagePaths, top_n: int = 10) -> list[str]:
    """Score the test part with the saved model and write the report tables."""
    _, cells, labels = st.load_gold(spark, stages)
    thresholds = st.load_thresholds(spark, stages)
    write_stage(score_split(spark, stages, "test", cells), stages.report("scores"))
    wide = read_stage(spark, stages.report("scores"), "error analysis")
    has_titles = path_exists(spark, stages.bronze("d_icd_diagnoses"))
    titles = read_stage(spark, stages.bronze("d_icd_diagnoses"), "bronze") if has_titles else None
    tables = error_tables(wide, thresholds, label_list(labels), titles, top_n)
    st.write_error_tables(tables.pop("per_label"), tables.pop("confusion_pairs"), stages)
    for name, df in tables.items():
        write_stage(df, stages.report(name))
    return ["per_label", "confusion_pairs", *tables]
