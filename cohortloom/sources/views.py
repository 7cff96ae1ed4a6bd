"""Views that give a generic star schema the shape of the cohort tables.

The same SQL text runs on Spark and, as common table expressions, on another SQL engine, so that
every operator can be checked against independent SQL on the same files. Only two spots differ
between the dialects: adding hours to a timestamp, and how a constant table is joined in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The six labels of the prediction views.
LABELS = ("A01", "B02", "C03", "D04", "E05", "F06")

NOTES = """
SELECT concat(CAST(doc_id AS VARCHAR(20)), '-', lang, '-', CAST(doc_id % 2 AS VARCHAR(20))) AS note_id,
  CAST(floor(doc_id / 2) AS BIGINT) % 97 AS subject_id,
  CAST(floor(doc_id / 2) AS BIGINT) * 37 AS hadm_id,
  lang AS note_type, CAST(doc_id % 2 AS INT) AS note_seq,
  CASE WHEN doc_id % 5 = 0 THEN concat('  Mr. ___  seen ', text, ' on _____ ') ELSE text END AS text
FROM documents"""

DIAGNOSES = """
SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
  CASE WHEN l_linenumber = 1
       THEN concat(' d', lpad(CAST((l_partkey * l_partkey) % 211 AS VARCHAR(20)), 4, '0'), ' ')
       ELSE concat('D', lpad(CAST((l_partkey * l_partkey) % 211 AS VARCHAR(20)), 4, '0')) END AS icd_code,
  CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 10 END AS icd_version
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

ADMISSIONS = """
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
  {add_hours} AS dischtime,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
FROM orders"""

PATIENTS = """
SELECT c_custkey AS subject_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CAST(10 + c_custkey % 85 AS INT) AS anchor_age, CAST(1990 + c_custkey % 10 AS INT) AS anchor_year,
  CASE c_nationkey % 4 WHEN 0 THEN '2008 - 2010' WHEN 1 THEN '2011 - 2013'
                       WHEN 2 THEN '2014 - 2016' ELSE '2017 - 2019' END AS anchor_year_group
FROM customer"""

DICTIONARY = """
SELECT concat('D', lpad(CAST(p_partkey AS VARCHAR(20)), 4, '0')) AS icd_code, 10 AS icd_version,
  p_name AS long_title
FROM part WHERE p_partkey < 150"""

_SCORE = "(doc_id * 7919 + label_idx * 10473 + doc_id * doc_id * (label_idx + 3)) % 97"

PREDICTIONS = f"""
SELECT doc_id AS hadm_id, label_idx, icd_code, CAST({_SCORE} AS DOUBLE) / 97.0 AS prob
FROM {{documents_by_label}}"""

TRUTH = f"""
SELECT doc_id AS hadm_id, icd_code FROM {{documents_by_label}}
WHERE {_SCORE} + (doc_id * 31 + label_idx * 17) % 60 > 85 + label_idx * 8"""

# The label table of the other engine; Spark takes the labels from the constant above.
LABEL_NAMES = "SELECT * FROM (VALUES {rows}) AS t(label_idx, icd_code)".format(
    rows=", ".join(f"({i},'{code}')" for i, code in enumerate(LABELS))
)

# Raw documents with the sensitive phrases of the scan put into every seventh text.
SCAN_DOCUMENTS = """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' MRN: 42 Chief Complaint: pain ')
                    ELSE text END AS text
FROM documents"""

_SPARK_ADD_HOURS = "timestampadd(HOUR, CAST(o_orderkey % 311 + 5 AS INT), o_orderdate)"
_ANSI_ADD_HOURS = "o_orderdate + to_hours(CAST(o_orderkey % 311 + 5 AS INT))"

# On Spark the constant labels are unfolded row by row, which needs no join.
_SPARK_BY_LABEL = "documents LATERAL VIEW inline(array({rows})) t AS label_idx, icd_code".format(
    rows=", ".join(f"struct({i}, '{code}')" for i, code in enumerate(LABELS))
)
_ANSI_BY_LABEL = "documents CROSS JOIN label_names"

# Rows of the larger side of a join that one task sorts about, and the keys of the views that join two tables.
TASK_ROWS = 500_000
JOIN_KEYS = {"diagnoses": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}

BASE_TABLES = {
    "notes": (NOTES, ("documents",)),
    "diagnoses": (DIAGNOSES, ("lineitem", "orders")),
    "admissions": (ADMISSIONS, ("orders",)),
    "patients": (PATIENTS, ("customer",)),
    "dictionary": (DICTIONARY, ("part",)),
    "predictions": (PREDICTIONS, ("documents",)),
    "truth": (TRUTH, ("documents",)),
    "scan_documents": (SCAN_DOCUMENTS, ("documents",)),
}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the cohort views over the given tables."""
    text, inputs = BASE_TABLES[name]
    text = text.replace("{add_hours}", _SPARK_ADD_HOURS)
    text = text.replace("{documents_by_label}", _SPARK_BY_LABEL)
    tables = {table: base(spark, sf_dir, table) for table in inputs}
    if name in JOIN_KEYS:
        tables = _dealt(tables, JOIN_KEYS[name])
    for table in inputs:
        text = _mention(text, table)
    return spark.sql(text, **tables)


def _dealt(tables: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """Deal both sides of a large join by key over as many tasks as their rows ask for.

    Spark sizes the tasks of a join by compressed bytes, and narrow sorted columns take many rows to fill one.
    The rows are counted from the file footers; a join of one task's rows is left to Spark.
    """
    tasks = -(-max(df.count() for df in tables.values()) // TASK_ROWS)
    if tasks <= 1:
        return tables
    cores = next(iter(tables.values())).sparkSession.sparkContext.defaultParallelism
    return {name: df.repartition(max(tasks, cores), keys[name]) for name, df in tables.items()}


def _mention(text: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table}", f"{word} {{{table}}}")
    return text


def ansi(name: str) -> str:
    """The text of a view for the other engine."""
    text = LABEL_NAMES if name == "label_names" else BASE_TABLES[name][0]
    text = text.replace("{add_hours}", _ANSI_ADD_HOURS)
    return text.replace("{documents_by_label}", _ANSI_BY_LABEL).strip()
