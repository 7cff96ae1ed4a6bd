"""The stages from raw files to test metrics, each one reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import features as fx
from cohortloom.operators import labels as lb
from cohortloom.operators import metrics as mx
from cohortloom.operators import model as md
from cohortloom.operators import scores as sc
from cohortloom.operators import splits as sp
from cohortloom.operators.coverage import restrict_to_coded_cohort
from cohortloom.operators.curate import build_silver_notes
from cohortloom.params import FeatureParams, RawPaths, RunParams
from cohortloom.session import spread
from cohortloom.sources import stages as st
from cohortloom.sources.stages import StagePaths, read_stage, write_stage

KEY = "hadm_id"


def run_bronze(spark: SparkSession, raw: RawPaths, stages: StagePaths) -> list[str]:
    """Raw files to Parquet."""
    return st.write_bronze(spark, raw, stages)


def run_silver(spark: SparkSession, params: RunParams, stages: StagePaths) -> None:
    """One clean note per admission."""
    notes = read_stage(spark, stages.bronze("discharge_notes"), "bronze")
    cohort = params.cohort
    st.write_silver(build_silver_notes(notes, cohort.note_types, cohort.min_tokens), stages)


def run_gold(spark: SparkSession, params: RunParams, stages: StagePaths) -> None:
    """Cohort notes and their labels. The silver table stays as it is, so every stage can rerun."""
    notes = read_stage(spark, stages.silver(), "silver")
    diagnoses = read_stage(spark, stages.bronze("diagnoses_icd"), "bronze")
    version, k = params.cohort.code_version, params.cohort.top_k
    write_stage(restrict_to_coded_cohort(notes, diagnoses, version), stages.gold("notes"))
    cohort = read_stage(spark, stages.gold("notes"), "gold")
    gate = params.cohort.max_unlabelled
    target = lb.build_labels(cohort.select(KEY), diagnoses, k, version, gate)
    write_stage(target.cells, stages.gold("labels"))
    write_stage(target.labels, stages.gold("label_names"))


def run_splits(spark: SparkSession, params: RunParams, stages: StagePaths) -> None:
    """The split manifest."""
    cohort = read_stage(spark, stages.gold("notes"), "gold").select(KEY, "subject_id")
    s = params.split
    st.write_splits(sp.patient_split(cohort, s.train, s.val, s.test, s.seed), stages)
    sp.require_disjoint(st.load_splits(spark, stages))


def fit_features(
    doc_terms: DataFrame, params: FeatureParams
) -> tuple[DataFrame, int]:
    """Vocabulary with inverse document frequencies, from training documents only, and its size."""
    vocab = fx.vocabulary(doc_terms, params.min_df, params.max_features)
    n_docs = doc_terms.count()
    return fx.inverse_frequency(vocab, n_docs), n_docs


def run_train(
    spark: SparkSession, params: RunParams, stages: StagePaths, run_id: str = "baseline"
) -> DataFrame:
    """Features and fits on train, thresholds and metrics on validation; all of it is persisted."""
    cohort, cells, labels = st.load_gold(spark, stages)
    manifest = st.load_splits(spark, stages)
    n_labels = labels.count()
    vectors = lb.label_vectors(cohort, cells, n_labels)
    lb.check_alignment(cohort, cells, dense=False)
    lb.check_alignment(cohort, manifest)
    low, high = params.features.ngram_range

    # Terms are counted once for all parts; the split is a folder of the features.
    terms = fx.document_terms(spread(cohort.select(KEY, "text")), low, high)
    write_stage(sp.join_split_manifest(terms, manifest), stages.gold("terms"), "split")
    terms = read_stage(spark, stages.gold("terms"), "train")
    train_terms = terms.filter(F.col("split") == "train").drop("split")

    idf, _ = fit_features(train_terms, params.features)
    write_stage(idf, stages.gold("vocabulary"))
    idf = read_stage(spark, stages.gold("vocabulary"), "train")
    size = idf.count()
    known = fx.term_dictionary(idf)

    model = md.fit_ovr_logistic(fx.tfidf(train_terms, known), vectors, labels, size, params.model)
    write_stage(model, stages.gold("model"))
    ev = params.evaluation
    wide = score_split(spark, stages, "val", truth=cells)
    write_stage(wide, stages.gold("scores_val"))
    wide = read_stage(spark, stages.gold("scores_val"), "train")
    thresholds = mx.tune_thresholds(
        sc.long_scores(wide), ev.threshold_metric, ev.min_support, ev.default_threshold
    )
    st.write_thresholds(_for_all_labels(thresholds, labels, ev.default_threshold), stages)
    thresholds = st.load_thresholds(spark, stages)
    return _write_metrics(wide, thresholds, n_labels, params, stages, "val", run_id)


def _for_all_labels(thresholds: DataFrame, labels: DataFrame, default: float) -> DataFrame:
    """One threshold per label, also where the part had no cells at all."""
    joined = labels.select("icd_code").join(thresholds, "icd_code", "left")
    return joined.select(
        "icd_code",
        F.coalesce("threshold", F.lit(default)).alias("threshold"),
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tuned", F.lit(False)).alias("tuned"),
    )


def score_split(
    spark: SparkSession, stages: StagePaths, split: str, truth: DataFrame
) -> DataFrame:
    """Scores of one part next to truth, from the saved model."""
    model, idf = md.load_model(spark, stages)
    terms = read_stage(spark, stages.gold("terms"), "train")
    part = terms.filter(F.col("split") == split).drop("split")
    size = idf.count()
    features = fx.tfidf(part, idf)
    return sc.align_scores(md.predict_proba(features, model, size), truth)


def _write_metrics(
    wide: DataFrame,
    thresholds: DataFrame,
    n_labels: int,
    params: RunParams,
    stages: StagePaths,
    split: str,
    run_id: str,
) -> DataFrame:
    metrics = mx.evaluate_multilabel(wide, thresholds, n_labels, params.evaluation.k_list)
    keyed = metrics.select(F.lit(run_id).alias("run_id"), "metric", "value")
    write_stage(keyed, stages.gold(f"metrics_{split}"))
    return read_stage(wide.sparkSession, stages.gold(f"metrics_{split}"), "train")


def run_evaluate_test(
    spark: SparkSession, params: RunParams, stages: StagePaths, run_id: str = "baseline"
) -> DataFrame:
    """Metrics of the saved model on the test part."""
    _, cells, labels = st.load_gold(spark, stages)
    thresholds = st.load_thresholds(spark, stages)
    write_stage(score_split(spark, stages, "test", cells), stages.gold("scores_test"))
    wide = read_stage(spark, stages.gold("scores_test"), "train")
    return _write_metrics(wide, thresholds, labels.count(), params, stages, "test", run_id)


def run_all(
    spark: SparkSession, raw: RawPaths, params: RunParams, stages: StagePaths
) -> DataFrame:
    """All stages in order; returns the test metrics."""
    run_bronze(spark, raw, stages)
    run_silver(spark, params, stages)
    run_gold(spark, params, stages)
    run_splits(spark, params, stages)
    run_train(spark, params, stages)
    return run_evaluate_test(spark, params, stages)
