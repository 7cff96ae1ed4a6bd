"""Classification, ranking and calibration metrics over scored cells.

Inputs are long scored tables ``(hadm_id, icd_code, prob, y)`` unless a name says ``wide``. Every
metric is a sum over cells that is merged before its shuffle; the curves work on the merged
``(label, score)`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.errors import MetricError
from cohortloom.functions.numbers import safe_ratio, sigmoid
from cohortloom.operators.ordered import running_sums
from cohortloom.operators.scores import with_thresholds
from cohortloom.session import cut_lineage, small_side

WIDE_INT = "decimal(38,0)"

# Metric, target and floor of the quality gates.
GATES = (
    ("micro_f1", 0.70, 0.55),
    ("macro_f1", 0.55, 0.40),
    ("p_at_5", 0.70, None),
    ("p_at_8", 0.65, None),
)


def f1_of(tp: Column, predicted: Column, positive: Column) -> Column:
    """F1 from counts, 0 where it is undefined."""
    return safe_ratio(2 * tp, predicted + positive)


# -- curves ------------------------------------------------------------------------------------


def score_counts(scored: DataFrame) -> DataFrame:
    """Cells and positives per label and distinct score."""
    return scored.groupBy("icd_code", "prob").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")
    )


def label_counts(scored: DataFrame) -> DataFrame:
    """Cells and positives per label."""
    return scored.groupBy("icd_code").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("y").cast("bigint").alias("n_pos")
    )


def cumulative_counts(counts: DataFrame, by: Sequence[str] = ("icd_code",)) -> DataFrame:
    """Cells (``predicted``) and positives (``tp``) at or above each distinct score.

    The totals of the group come along as ``n_all`` and ``n_pos``.
    """
    return running_sums(
        counts,
        [F.col("prob").desc()],
        {"n": "predicted", "pos": "tp"},
        by,
        totals={"n": "n_all", "pos": "n_pos"},
    )


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score of every label."""
    points = cumulative_counts(score_counts(scored))
    return points.select(
        "icd_code",
        F.col("prob").alias("score"),
        "tp",
        "predicted",
        safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
        "n_pos",
    )


def _curve_areas(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC AUC (ties count half) and step-wise average precision per group."""
    points = cumulative_counts(counts, by)
    # a positive beats the negatives strictly below its score, and half of those level with it
    negatives = F.col("n_all") - F.col("n_pos")
    level = F.col("n") - F.col("pos")
    below = negatives - (F.col("predicted") - F.col("tp"))
    twice_won = F.col("pos").cast(WIDE_INT) * (2 * below + level).cast("decimal(20,0)")
    step = F.col("pos").cast("double") * F.col("tp").cast("double") / F.col("predicted")
    grouped = points.groupBy(*by).agg(
        F.max("n_all").alias("n_all"),
        F.max("n_pos").alias("n_pos"),
        F.sum(twice_won.cast(WIDE_INT)).alias("_won"),
        F.sum(step).alias("_steps"),
    )
    pairs = F.col("n_pos").cast("double") * (F.col("n_all") - F.col("n_pos")).cast("double")
    return grouped.select(
        *by,
        "n_all",
        "n_pos",
        F.when(pairs > 0, F.col("_won").cast("double") / (2 * pairs)).alias("auc"),
        F.when(pairs > 0, F.col("_steps") / F.col("n_pos")).alias("ap"),
    )


def curve_areas(scored: DataFrame) -> DataFrame:
    """AUC and average precision per label; null for a label with one class."""
    return _curve_areas(score_counts(scored), ["icd_code"])


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """Micro and macro AUC and average precision in one row.

    All four are null if any label has only one class.
    """
    counts = cut_lineage(score_counts(scored), "score-counts")
    labels = _curve_areas(counts, ["icd_code"])
    micro_counts = counts.groupBy("prob").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    micro = _curve_areas(micro_counts, [])
    defined = F.count_if(F.col("auc").isNull()) == 0
    macro = labels.agg(
        F.when(defined, F.avg("auc")).alias("macro_auc"),
        F.when(defined, F.avg("ap")).alias("macro_auprc"),
    )
    return macro.select(
        F.when(F.col("macro_auc").isNotNull(), micro.select("auc").scalar()).alias("micro_auc"),
        "macro_auc",
        F.when(F.col("macro_auc").isNotNull(), micro.select("ap").scalar()).alias("micro_auprc"),
        "macro_auprc",
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("micro_auc", "macro_auc")


def average_precision(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("micro_auprc", "macro_auprc")


# -- thresholds --------------------------------------------------------------------------------


def tune_thresholds(
    scored: DataFrame,
    metric: str = "f1",
    min_support: int = 5,
    default_threshold: float = 0.5,
) -> DataFrame:
    """Best score of each label as its threshold, the lowest of equals.

    ``f1`` maximises F1, ``youden`` precision + recall - 1. Labels with little support keep the
    default.
    """
    if metric not in ("f1", "youden"):
        raise MetricError(f"unknown metric {metric!r}")
    points = pr_curve(scored)
    if metric == "f1":
        gain = f1_of(F.col("tp"), F.col("predicted"), F.col("n_pos"))
    else:
        gain = F.col("recall") - (F.lit(1.0) - F.col("precision"))
    # the greatest (gain, -score) pair per label, merged before the shuffle
    best = points.groupBy("icd_code").agg(
        F.max_by("score", F.struct(gain.alias("gain"), (-F.col("score")).alias("low"))).alias("best"),
        F.max("n_pos").alias("support"),
    )
    tuned = F.col("support") >= min_support
    return best.select(
        "icd_code",
        F.when(tuned, F.col("best")).otherwise(F.lit(float(default_threshold))).alias("threshold"),
        "support",
        tuned.alias("tuned"),
    )


def threshold_summary(thresholds: DataFrame) -> DataFrame:
    """Spread of the thresholds and how many were tuned."""
    return thresholds.agg(
        F.min("threshold").alias("min"),
        F.median("threshold").alias("median"),  # one row per label
        F.max("threshold").alias("max"),
        F.count_if("tuned").alias("n_tuned"),
        F.count_if(~F.col("tuned")).alias("n_default"),
    )


# -- counts at thresholds ----------------------------------------------------------------------


def confusion_counts(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """True positives, predictions and positives per label."""
    predicted = with_thresholds(scored, thresholds)
    return predicted.groupBy("icd_code").agg(
        F.sum(F.col("y") * F.col("pred")).alias("tp"),
        F.sum("pred").alias("predicted"),
        F.sum("y").alias("support"),
        F.first("threshold").alias("threshold"),
    )


def per_label_metrics(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and threshold per label."""
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return confusion_counts(scored, thresholds).select(
        "icd_code",
        safe_ratio(tp, predicted).alias("precision"),
        safe_ratio(tp, support).alias("recall"),
        f1_of(tp, predicted, support).alias("f1"),
        "support",
        "threshold",
    )


def f1_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro and macro F1 from counts per label."""
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return counts.groupBy(*by).agg(
        f1_of(F.sum(tp), F.sum(predicted), F.sum(support)).alias("micro_f1"),
        F.avg(f1_of(tp, predicted, support)).alias("macro_f1"),
    )


def micro_f1(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    return f1_scores(confusion_counts(scored, thresholds)).select("micro_f1")


def macro_f1(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    return f1_scores(confusion_counts(scored, thresholds)).select("macro_f1")


def fixed_threshold_f1(logits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """F1 scores of cells with a ``logit``, all labels cut at one probability."""
    pred = (sigmoid(F.col("logit")) >= threshold).cast("int")
    counts = logits.groupBy("icd_code").agg(
        F.sum(F.col("y") * pred).alias("tp"),
        F.sum(pred).alias("predicted"),
        F.sum("y").alias("support"),
    )
    return f1_scores(counts)


def precision_at_k(wide: DataFrame, k_list: Sequence[int], n_labels: int) -> DataFrame:
    """Mean share of positives among the ``k`` best scores of a document, ties by code.

    Each document is ordered inside its row, for every ``k`` in the same pass.
    """
    for k in k_list:
        if not 1 <= k <= n_labels:
            raise MetricError(f"k={k} is outside 1..{n_labels}")
    ordered = F.array_sort(
        F.transform("cells", lambda c: F.struct((-c["prob"]).alias("m"), c["icd_code"], c["y"].alias("y")))
    )
    ranked_y = wide.select(F.transform(ordered, lambda c: c["y"]).alias("ys"))

    def hits(k: int) -> Column:
        return F.aggregate(F.slice("ys", 1, k), F.lit(0), lambda acc, y: acc + y)

    sums = ranked_y.agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(hits(k)).alias(f"_{k}") for k in k_list]
    )
    cells = [
        F.struct(
            F.lit(k).alias("k"),
            safe_ratio(F.col(f"_{k}"), F.col("_n") * k).alias("precision_at_k"),
        )
        for k in k_list
    ]
    return sums.select(F.inline(F.array(*cells)))


def evaluate_multilabel(
    wide: DataFrame,
    thresholds: DataFrame,
    n_labels: int,
    k_list: Sequence[int] = (5, 8, 15),
) -> DataFrame:
    """All headline metrics as ``(metric, value)`` rows; the value of an undefined one is null."""
    from cohortloom.operators.scores import long_scores

    small = small_side(thresholds)
    found = small.count()
    if found != n_labels:
        raise MetricError(f"{found} thresholds for {n_labels} labels")
    scored = long_scores(wide)
    f1 = as_rows(f1_scores(confusion_counts(scored, small)))
    curves = as_rows(ranking_metrics(scored))
    at_k = precision_at_k(wide, k_list, n_labels).select(
        F.concat(F.lit("p_at_"), F.col("k")).alias("metric"), F.col("precision_at_k").alias("value")
    )
    return reduce(DataFrame.unionByName, [f1, curves, at_k])


def as_rows(one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table as ``(metric, value)`` rows."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*cells)))


def metric_row(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metric rows as one flat row."""
    return metrics.groupBy().pivot("metric", list(names)).agg(F.first("value"))


# -- calibration -------------------------------------------------------------------------------


def brier_per_label(scored: DataFrame) -> DataFrame:
    """Mean squared distance of probability and truth per label."""
    off = F.col("prob") - F.col("y")
    return scored.groupBy("icd_code").agg(F.avg(off * off).alias("brier"))


def macro_brier(scored: DataFrame) -> DataFrame:
    return brier_per_label(scored).agg(F.avg("brier").alias("macro_brier"))


def reliability_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean probability and observed rate per equal bin, left-closed, the last one closed."""
    p = F.col("prob")
    step = F.lit(1.0 / bins)
    edges = [F.lit(i) * step for i in range(bins)]
    place = reduce(lambda a, b: a + b, [(p >= e).cast("int") for e in edges]) - 1
    inside = scored.filter((p >= 0.0) & (p <= 1.0)).withColumn("bin", place)
    return inside.groupBy("bin").agg(
        F.avg("prob").alias("mean_prob"),
        F.avg("y").alias("observed_rate"),
        F.count(F.lit(1)).alias("n"),
    )


# -- comparisons -------------------------------------------------------------------------------


def prediction_summary(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Positive and predicted cells, and the share of cells predicted."""
    cells = with_thresholds(scored, thresholds)
    return cells.agg(
        F.sum("y").alias("positives_true"),
        F.sum("pred").alias("positives_pred"),
        F.avg("pred").alias("mean_pred_rate"),
    )


def split_drift(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Metric rows of two parts side by side with their difference; null for what one part lacks."""
    other = test.select("metric", F.col("value").alias("test"))
    both = validation.select("metric", F.col("value").alias("val")).join(other, "metric", "full")
    return both.withColumn("drift", F.abs(F.col("val") - F.col("test")))


def metric_gates(metrics: DataFrame) -> DataFrame:
    """All gates with their target and floor, next to the metric; a missing floor counts as passed.

    A gate whose metric is absent or undefined has a null value and is not met.
    """
    gates = [
        F.struct(
            F.lit(name).alias("metric"),
            F.lit(target).cast("double").alias("target"),
            F.lit(floor).cast("double").alias("floor"),
        )
        for name, target, floor in GATES
    ]
    # the gates ride on one row that holds the values of the few gated metrics
    named = [F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name, _, _ in GATES]
    cells = [F.struct(g.alias("g"), F.col(name).alias("value")) for g, (name, _, _) in zip(gates, GATES)]
    gated = metrics.agg(*named).select(F.inline(F.array(*cells)))
    target, floor = F.col("g.target"), F.col("g.floor")
    return gated.select(
        F.col("g.metric").alias("metric"),
        "value",
        target.alias("target"),
        floor.alias("floor"),
        F.coalesce(F.col("value") >= target, F.lit(False)).alias("meets_target"),
        F.when(floor.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("value") >= floor, F.lit(False))).alias("meets_floor"),
    )


def fairness_slices(
    wide: DataFrame,
    subjects: DataFrame,
    thresholds: dict[str, float],
    dimensions: dict[str, str],
    gap: float = 0.05,
) -> DataFrame:
    """Macro F1 per value of each dimension, flagged where it trails the best by ``gap`` or more.

    ``subjects`` has one row per document with the columns that ``dimensions`` names. Documents are
    joined as single rows; cells unfold afterwards and are summed before the shuffle.
    """
    joined = wide.join(subjects, "hadm_id")
    cut = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    slices = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(column).alias("slice"))
            for name, column in dimensions.items()
        ]
    )
    unfolded = joined.select("cells", F.inline(slices)).filter("slice IS NOT NULL")
    cells = unfolded.select("dimension", "slice", F.inline("cells"))
    pred = (F.col("prob") >= F.try_element_at(cut, F.col("icd_code"))).cast("int")
    counts = cells.groupBy("dimension", "slice", "icd_code").agg(
        F.sum(F.col("y") * pred).alias("tp"),
        F.sum(pred).alias("predicted"),
        F.sum("y").alias("support"),
        F.count(F.lit(1)).alias("n_docs"),
    )
    by = ["dimension", "slice"]
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    per_slice = counts.groupBy(*by).agg(
        F.avg(f1_of(tp, predicted, support)).alias("macro_f1"), F.max("n_docs").alias("n_docs")
    )
    best = per_slice.groupBy("dimension").agg(F.max("macro_f1").alias("best"))
    return per_slice.join(best, "dimension").select(
        *by,
        "n_docs",
        "macro_f1",
        (F.col("best") - F.col("macro_f1")).alias("gap"),
        (F.col("best") - F.col("macro_f1") >= gap).alias("flagged"),
    )
