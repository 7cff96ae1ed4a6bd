"""Sources, sinks and stages, each as a round trip of the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import schemas
from cohortloom.catalog.coverage import silver, silver_keys
from cohortloom.catalog.labelling import target
from cohortloom.catalog.registry import MIN_TOKENS, NOTE_TYPES, TOP_K, query
from cohortloom.operators import confusion as cf
from cohortloom.operators import metrics as mx
from cohortloom.operators import scores as sc
from cohortloom.operators import splits as sp
from cohortloom.params import CohortParams, RawPaths, RunParams
from cohortloom.plans import error_analysis as ea
from cohortloom.plans import profiling as pp
from cohortloom.plans import stages as ps
from cohortloom.session import fresh_path
from cohortloom.sources import raw
from cohortloom.sources import stages as st
from cohortloom.sources.stages import StagePaths
from cohortloom.sources.views import LABELS


def _as_schema(df, schema):
    """The columns of a raw table; those a view lacks are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _write_csv(df, path):
    """Gzipped CSV with a header, every text quoted, quotes doubled."""
    writer = df.write.option("header", True).option("compression", "gzip").option("escape", '"')
    writer.option("quoteAll", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_SCHEMAS = {
    "notes": schemas.NOTES,
    "diagnoses": schemas.DIAGNOSES,
    "admissions": schemas.ADMISSIONS,
    "patients": schemas.PATIENTS,
    "dictionary": schemas.CODE_DICTIONARY,
}


def raw_file(t, name):
    """One view as a raw file, with a column more than the reader wants and a shouting header."""
    df = _as_schema(getattr(t, name), _SCHEMAS[name]).withColumn("storetime", F.lit("x"))
    shouting = df.toDF(*[c.upper() for c in df.columns])
    return _write_csv(shouting, fresh_path(t.spark, f"raw-{name}"))


def raw_paths(t):
    return RawPaths(*[raw_file(t, n) for n in ("notes", "diagnoses", "admissions", "patients", "dictionary")])


_NOTES_SQL = "SELECT note_id, subject_id, hadm_id, note_type, note_seq, text FROM notes"


@query("read_raw_csv", _NOTES_SQL)
def _(t):
    df = raw.read_raw_csv(t.spark, raw_file(t, "notes"), schemas.NOTES)
    return df.drop("charttime")


@query("read_notes", _NOTES_SQL)
def _(t):
    return raw.read_notes(t.spark, raw_file(t, "notes")).drop("charttime")


@query("read_diagnoses", "SELECT * FROM diagnoses")
def _(t):
    return raw.read_diagnoses(t.spark, raw_file(t, "diagnoses"))


@query("read_admissions", "SELECT * FROM admissions")
def _(t):
    df = raw.read_admissions(t.spark, raw_file(t, "admissions"))
    return df.select("subject_id", "hadm_id", "admittime", "dischtime", "hospital_expire_flag")


@query("read_patients", "SELECT * FROM patients")
def _(t):
    return raw.read_patients(t.spark, raw_file(t, "patients")).drop("dod")


@query("read_code_dictionary", "SELECT * FROM dictionary")
def _(t):
    return raw.read_code_dictionary(t.spark, raw_file(t, "dictionary"))


def _stages(t, label):
    return StagePaths(fresh_path(t.spark, label))


_BRONZE_COUNTS = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, count(*) AS n FROM {view}"
    for table, view in [
        ("discharge_notes", "notes"), ("diagnoses_icd", "diagnoses"), ("admissions", "admissions"),
        ("patients", "patients"), ("d_icd_diagnoses", "dictionary"),
    ]
)


@query("write_bronze", _BRONZE_COUNTS)
def _(t):
    stages = _stages(t, "bronze")
    names = st.write_bronze(t.spark, raw_paths(t), stages)
    counts = [
        st.read_stage(t.spark, stages.bronze(n), "bronze").agg(
            F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "bronze_ingest_stamp",
    "SELECT subject_id, gender, true AS stamped FROM patients",
)
def _(t):
    stamped = st.bronze_ingest_stamp(t.patients)
    return stamped.select("subject_id", "gender", F.col("_ingested_at").isNotNull().alias("stamped"))


@query("read_stage", "SELECT subject_id, hadm_id, admittime, hospital_expire_flag FROM admissions")
def _(t):
    stages = _stages(t, "stage")
    st.write_stage(t.admissions, stages.bronze("admissions"))
    df = st.read_stage(t.spark, stages.bronze("admissions"), "bronze")
    return df.select("subject_id", "hadm_id", "admittime", "hospital_expire_flag")


@query("write_silver", "SELECT note_id, subject_id, hadm_id, text, n_tokens FROM silver")
def _(t):
    stages = _stages(t, "silver")
    st.write_silver(silver(t), stages)
    return st.read_stage(t.spark, stages.silver(), "silver")


@query("write_gold_labels", "SELECT hadm_id, label_idx, icd_code FROM cohort_cells")
def _(t):
    stages = _stages(t, "gold")
    notes, labels = target(t)
    st.write_gold_labels(notes, labels.cells, labels.labels, stages)
    return st.load_gold(t.spark, stages)[1]


@query("load_gold", "SELECT label_idx, icd_code FROM cohort_labels")
def _(t):
    stages = _stages(t, "gold")
    notes, labels = target(t)
    st.write_gold_labels(notes, labels.cells, labels.labels, stages)
    return st.load_gold(t.spark, stages)[2]


@query("write_splits", "SELECT hadm_id, subject_id, split FROM manifest")
def _(t):
    stages = _stages(t, "splits")
    st.write_splits(sp.patient_split(silver_keys(t)), stages)
    return st.load_splits(t.spark, stages)


@query("load_splits", "SELECT hadm_id, subject_id FROM manifest WHERE split = 'test'")
def _(t):
    stages = _stages(t, "splits")
    st.write_splits(sp.patient_split(silver_keys(t)), stages)
    return st.load_splits(t.spark, stages).filter("split = 'test'").select("hadm_id", "subject_id")


@query("write_thresholds", "SELECT icd_code, threshold FROM cutoffs")
def _(t):
    stages = _stages(t, "thresholds")
    st.write_thresholds(t.cutoffs, stages)
    return st.load_thresholds(t.spark, stages)


@query("write_error_tables", "SELECT icd_code, precision, recall, f1, support, threshold FROM per_label")
def _(t):
    stages = _stages(t, "errors")
    per_label = mx.per_label_metrics(t.scored, t.cutoffs)
    counts = cf.substitution_counts(t.wide, sc.threshold_map(t.cutoffs), list(LABELS))
    st.write_error_tables(per_label, cf.confusion_pairs(counts, per_label, t.dictionary), stages)
    return st.read_stage(t.spark, stages.report("per_label"), "error analysis")


PARAMS = RunParams(cohort=CohortParams(10, MIN_TOKENS, TOP_K, NOTE_TYPES))


@query("run_bronze", _BRONZE_COUNTS)
def _(t):
    stages = _stages(t, "run")
    names = ps.run_bronze(t.spark, raw_paths(t), stages)
    counts = [
        st.read_stage(t.spark, stages.bronze(n), "bronze").agg(
            F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)


def _bronze(t, label):
    """The bronze tables of a run, straight from the views."""
    stages = _stages(t, label)
    tables = {
        "discharge_notes": t.notes, "diagnoses_icd": t.diagnoses, "admissions": t.admissions,
        "patients": t.patients, "d_icd_diagnoses": t.dictionary,
    }
    for name, df in tables.items():
        st.write_stage(df, stages.bronze(name))
    return stages


@query("run_silver", "SELECT note_id, subject_id, hadm_id, text, n_tokens FROM silver")
def _(t):
    stages = _bronze(t, "run")
    ps.run_silver(t.spark, PARAMS, stages)
    return st.read_stage(t.spark, stages.silver(), "silver")


@query("run_gold", "SELECT note_id, hadm_id, n_tokens FROM cohort")
def _(t):
    stages = _bronze(t, "run")
    ps.run_silver(t.spark, PARAMS, stages)
    ps.run_gold(t.spark, PARAMS, stages)
    return st.load_gold(t.spark, stages)[0].select("note_id", "hadm_id", "n_tokens")


@query(
    "run_splits",
    """WITH people AS (SELECT subject_id, row_number() OVER (ORDER BY md5('42:' || subject_id)) AS r,
         count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM cohort))
       SELECT hadm_id, c.subject_id, CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train'
         WHEN r <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split
       FROM cohort c JOIN people USING (subject_id)""",
)
def _(t):
    stages = _bronze(t, "run")
    for stage in (ps.run_silver, ps.run_gold, ps.run_splits):
        stage(t.spark, PARAMS, stages)
    return st.load_splits(t.spark, stages)


@query("run_all")
def _(t):
    stages = _stages(t, "run")
    return ps.run_all(t.spark, raw_paths(t), PARAMS, stages)


@query("run_eda")
def _(t):
    stages = _bronze(t, "eda")
    names = pp.run_eda(t.spark, stages)
    counts = [
        st.read_stage(t.spark, stages.report(f"eda_{n}"), "profiling").agg(
            F.lit(n).alias("report"), F.count(F.lit(1)).alias("n")
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)


@query("run_error_analysis")
def _(t):
    stages = _bronze(t, "errors")
    for stage in (ps.run_silver, ps.run_gold, ps.run_splits, ps.run_train):
        stage(t.spark, PARAMS, stages)
    ea.run_error_analysis(t.spark, stages)
    return st.read_stage(t.spark, stages.report("per_label"), "error analysis").select(
        "icd_code", "description", "support", "f1", "brier"
    )
