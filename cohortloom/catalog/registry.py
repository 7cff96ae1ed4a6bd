"""How queries, the tables they read and their SQL twins are declared."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import metrics as mx
from cohortloom.operators import scores as sc
from cohortloom.session import spread
from cohortloom.sources import views

# Parameters of the registered queries.
NOTE_TYPES = ("en", "fr", "de")
MIN_TOKENS = 100
VERSION = 10
TOP_K = 25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The cohort views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return views.base(self.spark, self.sf_dir, name)

    def _view(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)

    @property
    def notes(self) -> DataFrame:
        return self._view("notes")

    @property
    def texts(self) -> DataFrame:
        """The notes on all cores, for queries that work on their text."""
        return spread(self.notes)

    @property
    def diagnoses(self) -> DataFrame:
        return self._view("diagnoses")

    @property
    def coded(self) -> DataFrame:
        return self.diagnoses.filter(F.col("icd_version") == VERSION)

    @property
    def admissions(self) -> DataFrame:
        return self._view("admissions")

    @property
    def patients(self) -> DataFrame:
        return self._view("patients")

    @property
    def dictionary(self) -> DataFrame:
        return self._view("dictionary")

    @property
    def predictions(self) -> DataFrame:
        return self._view("predictions")

    @property
    def truth(self) -> DataFrame:
        return self._view("truth")

    @property
    def scan_documents(self) -> DataFrame:
        return spread(self._view("scan_documents"))

    @property
    def scores(self) -> DataFrame:
        """Predictions of a document in one row, as a model emits them."""
        return self.scores_of(self.base("documents"))

    @staticmethod
    def scores_of(documents: DataFrame) -> DataFrame:
        """The scores of the prediction view for a batch or stream of documents."""
        doc = F.col("doc_id")
        cells = [
            F.struct(
                F.lit(code).alias("icd_code"),
                (
                    ((doc * 7919 + i * 10473 + doc * doc * (i + 3)) % 97).cast("double") / 97.0
                ).alias("prob"),
            )
            for i, code in enumerate(views.LABELS)
        ]
        return documents.select(doc.alias("hadm_id"), F.array(*cells).alias("scores"))

    @property
    def wide(self) -> DataFrame:
        """Wide scores with truth."""
        return sc.align_scores(self.scores, self.truth)

    @property
    def scored(self) -> DataFrame:
        """Long cells with truth."""
        return sc.long_scores(self.wide)

    @cached_property
    def cutoffs(self) -> DataFrame:
        """A threshold per label: the share of cells that are negative."""
        share = 1.0 - F.col("n_pos") / F.col("n_all")
        return mx.label_counts(self.scored).select("icd_code", share.alias("threshold"))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under the name of its operator, with its SQL twin."""

    def keep(body: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: body(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return body

    return keep


# -- SQL of the other engine -------------------------------------------------------------------

SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
NOT_SPACE = r"[^\s\x1c-\x1f\x{85}\p{Z}]+"


def clean(text: str = "text") -> str:
    marked = f"regexp_replace({text}, '_{{2,}}', ' [REDACTED] ', 'g')"
    return f"coalesce(trim(regexp_replace({marked}, '{SPACE}', ' ', 'g')), '')"


def tokens(text: str = "text") -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{NOT_SPACE}')), 0)"


def norm(code: str = "icd_code") -> str:
    return rf"upper(regexp_replace({code}, '^\s+|\s+$', '', 'g'))"


_TYPES = ", ".join(f"'{t}'" for t in NOTE_TYPES)

SHARED = {
    "silver": f"""
SELECT note_id, subject_id, hadm_id, text, {tokens()} AS n_tokens FROM (
  SELECT note_id, subject_id, hadm_id, {clean()} AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY note_seq DESC, note_id DESC) AS rn
    FROM notes WHERE note_type IN ({_TYPES})) WHERE rn = 1)
WHERE {tokens()} >= {MIN_TOKENS}""",
    "lengths": f"""
SELECT note_id, hadm_id, note_type, length(coalesce(text, '')) AS n_chars, {tokens()} AS n_tokens
FROM notes""",
    "codes": f"""
SELECT hadm_id, {norm()} AS icd_code FROM diagnoses WHERE icd_version = {VERSION}""",
    "cohort": "SELECT * FROM silver WHERE hadm_id IN (SELECT hadm_id FROM codes)",
    "cohort_codes": "SELECT * FROM codes WHERE hadm_id IN (SELECT hadm_id FROM silver)",
    "cohort_labels": f"""
SELECT icd_code, CAST(row_number() OVER (ORDER BY icd_code) - 1 AS INT) AS label_idx FROM (
  SELECT icd_code, count(*) AS n FROM cohort_codes GROUP BY icd_code
  ORDER BY n DESC, icd_code LIMIT {TOP_K})""",
    "cohort_cells": """
SELECT DISTINCT hadm_id, label_idx, c.icd_code FROM cohort_codes c JOIN cohort_labels USING (icd_code)""",
    "cohort_matrix": """
SELECT h.hadm_id, l.icd_code, l.label_idx, CASE WHEN c.hadm_id IS NULL THEN 0 ELSE 1 END AS present
FROM cohort h CROSS JOIN cohort_labels l
LEFT JOIN cohort_cells c ON c.hadm_id = h.hadm_id AND c.icd_code = l.icd_code""",
    "frequency": """
SELECT icd_code, count(*) AS n_codes, count(DISTINCT hadm_id) AS n_admissions,
  row_number() OVER (ORDER BY count(*) DESC, icd_code) AS rank
FROM codes GROUP BY icd_code""",
    "titles": f"""
SELECT {norm()} AS icd_code, min(long_title) AS long_title FROM dictionary
WHERE icd_version = {VERSION} GROUP BY 1""",
    "keys": f"""
SELECT hadm_id, max(n) AS n, max(a) AS a, max(d) AS d FROM (
  SELECT hadm_id, 1 AS n, 0 AS a, 0 AS d FROM notes
  UNION ALL SELECT hadm_id, 0, 1, 0 FROM admissions
  UNION ALL SELECT hadm_id, 0, 0, 1 FROM diagnoses WHERE icd_version = {VERSION})
WHERE hadm_id IS NOT NULL GROUP BY hadm_id""",
    "three_way": "SELECT hadm_id FROM keys WHERE n = 1 AND a = 1 AND d = 1",
    "cohort_stays": "SELECT * FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM three_way)",
    "per_patient": """
SELECT subject_id, count(*) AS n_admissions FROM admissions
WHERE subject_id IS NOT NULL GROUP BY subject_id""",
    "stays": """
SELECT *, (epoch_us(dischtime) - epoch_us(admittime)) / 86400000000.0 AS los_days FROM admissions""",
    "subjects_ranked": """
SELECT subject_id, row_number() OVER (ORDER BY md5('42:' || subject_id)) AS r,
  count(*) OVER () AS n
FROM (SELECT DISTINCT subject_id FROM cohort_all)""",
    "cohort_all": "SELECT hadm_id, subject_id FROM silver",
    "manifest": """
SELECT c.hadm_id, c.subject_id,
  CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train'
       WHEN r <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split
FROM cohort_all c JOIN subjects_ranked USING (subject_id)""",
    "scored": """
SELECT p.hadm_id, p.icd_code, p.label_idx, p.prob, CASE WHEN t.hadm_id IS NULL THEN 0 ELSE 1 END AS y
FROM predictions p LEFT JOIN truth t ON t.hadm_id = p.hadm_id AND t.icd_code = p.icd_code""",
    "cutoffs": """
SELECT icd_code, 1.0::DOUBLE - CAST(sum(y) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS threshold
FROM scored GROUP BY icd_code""",
    "decided": """
SELECT s.*, threshold, CASE WHEN prob >= threshold THEN 1 ELSE 0 END AS pred
FROM scored s JOIN cutoffs USING (icd_code)""",
    "label_counts": """
SELECT icd_code, CAST(sum(y * pred) AS DOUBLE) AS tp, CAST(sum(pred) AS DOUBLE) AS predicted,
  CAST(sum(y) AS DOUBLE) AS support, any_value(threshold) AS threshold
FROM decided GROUP BY icd_code""",
    "per_label": """
SELECT icd_code, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1,
  CAST(support AS BIGINT) AS support, threshold
FROM label_counts""",
    "curve": """
SELECT icd_code, prob AS score,
  CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS predicted,
  CAST(sum(pos) OVER (PARTITION BY icd_code) AS BIGINT) AS n_pos,
  CAST(sum(n) OVER (PARTITION BY icd_code) AS BIGINT) AS n_all, n, pos
FROM (SELECT icd_code, prob, count(*) AS n, sum(y) AS pos FROM scored GROUP BY icd_code, prob)
WINDOW w AS (PARTITION BY icd_code ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)""",
    "label_areas": """
SELECT icd_code,
  CAST(sum(pos * (2 * ((n_all - n_pos) - (predicted - tp)) + (n - pos))) AS DOUBLE)
    / (2.0::DOUBLE * any_value(n_pos) * (any_value(n_all) - any_value(n_pos))) AS auc,
  sum(CAST(pos AS DOUBLE) * tp / predicted) / any_value(n_pos) AS ap
FROM curve GROUP BY icd_code""",
    "micro_curve": """
SELECT prob, sum(pos) OVER w AS tp, sum(n) OVER w AS predicted, n, pos,
  sum(pos) OVER () AS n_pos, sum(n) OVER () AS n_all
FROM (SELECT prob, count(*) AS n, sum(y) AS pos FROM scored GROUP BY prob)
WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)""",
    "micro_areas": """
SELECT CAST(sum(pos * (2 * ((n_all - n_pos) - (predicted - tp)) + (n - pos))) AS DOUBLE)
    / (2.0::DOUBLE * any_value(n_pos) * (any_value(n_all) - any_value(n_pos))) AS auc,
  sum(CAST(pos AS DOUBLE) * tp / predicted) / any_value(n_pos) AS ap
FROM micro_curve""",
    "f1_pair": """
SELECT 2 * sum(tp) / (sum(predicted) + sum(support)) AS micro_f1,
  avg(CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END) AS macro_f1
FROM label_counts""",
    "hits": """
SELECT hadm_id, y, row_number() OVER (PARTITION BY hadm_id ORDER BY prob DESC, icd_code) AS place
FROM scored""",
    "metric_rows": """
SELECT 'micro_f1' AS metric, micro_f1 AS value FROM f1_pair
UNION ALL SELECT 'macro_f1', macro_f1 FROM f1_pair
UNION ALL SELECT 'micro_auc', auc FROM micro_areas
UNION ALL SELECT 'macro_auc', avg(auc) FROM label_areas
UNION ALL SELECT 'micro_auprc', ap FROM micro_areas
UNION ALL SELECT 'macro_auprc', avg(ap) FROM label_areas
UNION ALL SELECT 'p_at_' || k, CAST(sum(y) AS DOUBLE) / (k * (SELECT count(DISTINCT hadm_id) FROM hits))
  FROM hits JOIN (VALUES (1), (3), (5)) AS v(k) ON place <= k GROUP BY k""",
    "substitutions": """
SELECT t.icd_code AS true_code, w.icd_code AS wrong_code, count(*) AS count
FROM decided t JOIN decided w ON t.hadm_id = w.hadm_id
WHERE t.y = 1 AND w.y = 0 AND w.pred = 1 AND t.icd_code <> w.icd_code GROUP BY 1, 2""",
    "involvement": """
SELECT icd_code, CAST(sum(count) AS BIGINT) AS involvement FROM (
  SELECT true_code AS icd_code, count FROM substitutions
  UNION ALL SELECT wrong_code, count FROM substitutions) GROUP BY icd_code""",
    "words": r"""
SELECT note_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS w FROM notes""",
    "grams": """
SELECT note_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
FROM words""",
    "doc_terms": "SELECT note_id, term, count(*) AS tf FROM grams GROUP BY note_id, term",
    "vocab": """
SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM (
  SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM doc_terms GROUP BY term
  HAVING count(*) >= 5 ORDER BY tf DESC, term LIMIT 5000)""",
    "weights": """
SELECT note_id, term_idx, (1 + ln(d.tf)) * (ln((1.0 + (SELECT count(*) FROM words)) / (1.0 + df)) + 1) AS w
FROM doc_terms d JOIN vocab v USING (term)""",
}


def expand(sql: str) -> str:
    """Prefix SQL with every view it mentions, directly or through another view."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in [*views.BASE_TABLES, "label_names", *SHARED]:
            if name in order or not re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                continue
            body = SHARED[name] if name in SHARED else views.ansi(name)
            need(body)
            if name not in order:
                order.append(name)
                bodies[name] = body.strip()

    bodies: dict[str, str] = {}
    need(sql)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({bodies[name]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
