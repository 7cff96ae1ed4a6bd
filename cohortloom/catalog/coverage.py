"""Joins, set operations and coverage."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import MIN_TOKENS, NOTE_TYPES, TOP_K, VERSION, query, tokens
from cohortloom.operators import coverage as cv
from cohortloom.operators import labels as lb
from cohortloom.operators import profile as pf
from cohortloom.operators import scores as sc
from cohortloom.operators import splits as sp
from cohortloom.session import cut_lineage
from cohortloom.operators.curate import build_silver_notes, filter_code_version


def silver(t):
    return build_silver_notes(t.notes, NOTE_TYPES, MIN_TOKENS)


def silver_keys(t):
    """Admissions and subjects of the silver notes, written down for readers that need them twice."""
    return cut_lineage(silver(t).select("note_id", "hadm_id", "subject_id"), "silver-keys")


@query("restrict_to_coded_cohort", "SELECT note_id, hadm_id, n_tokens FROM cohort")
def _(t):
    return cv.restrict_to_coded_cohort(silver(t), t.diagnoses).select("note_id", "hadm_id", "n_tokens")


@query("restrict_codes_to_cohort", "SELECT hadm_id, icd_code FROM cohort_codes")
def _(t):
    return cv.restrict_codes_to_cohort(filter_code_version(t.diagnoses), silver(t))


@query(
    "restrict_to_labels",
    "SELECT hadm_id, icd_code FROM cohort_codes WHERE icd_code IN (SELECT icd_code FROM cohort_labels)",
)
def _(t):
    codes = cv.restrict_codes_to_cohort(filter_code_version(t.diagnoses), silver_keys(t))
    return lb.restrict_to_labels(codes, lb.top_k_codes(codes, TOP_K))


@query(
    "join_admission_year",
    """SELECT d.hadm_id, seq_num, CAST(year(admittime) AS INT) AS year
       FROM diagnoses d LEFT JOIN admissions a USING (hadm_id)""",
)
def _(t):
    return cv.join_admission_year(t.diagnoses, t.admissions).select("hadm_id", "seq_num", "year")


@query(
    "join_code_titles",
    """SELECT rank, f.icd_code, long_title FROM (SELECT * FROM frequency ORDER BY rank LIMIT 50) f
       LEFT JOIN titles USING (icd_code)""",
)
def _(t):
    first = pf.top_frequency(t.diagnoses, 50)
    return pf.join_code_titles(first, t.dictionary).select("rank", "icd_code", "long_title")


@query(
    "cohort_three_way",
    """SELECT hadm_id, subject_id, gender, anchor_age FROM cohort_stays JOIN patients USING (subject_id)""",
)
def _(t):
    stays, _, people = cv.cohort_three_way(t.notes, t.admissions, t.diagnoses, t.patients)
    return stays.join(people, "subject_id").select("hadm_id", "subject_id", "gender", "anchor_age")


@query(
    "join_coverage",
    f"""SELECT slice, count FROM (SELECT
      count(*) FILTER (n = 1 AND a = 0 AND d = 0) AS notes_only,
      count(*) FILTER (a = 1 AND n = 0 AND d = 0) AS adm_only,
      count(*) FILTER (d = 1 AND n = 0 AND a = 0) AS dx_only,
      count(*) FILTER (n = 1 AND a = 1 AND d = 0) AS notes_and_adm,
      count(*) FILTER (n = 1 AND d = 1 AND a = 0) AS notes_and_dx,
      count(*) FILTER (a = 1 AND d = 1 AND n = 0) AS adm_and_dx,
      count(*) FILTER (n = 1 AND a = 1 AND d = 1) AS all_three,
      count(*) FILTER (n = 1) AS total_notes, count(*) FILTER (a = 1) AS total_adm,
      count(*) FILTER (d = 1) AS total_dx_v{VERSION} FROM keys)
      UNPIVOT (count FOR slice IN (notes_only, adm_only, dx_only, notes_and_adm, notes_and_dx,
        adm_and_dx, all_three, total_notes, total_adm, total_dx_v{VERSION}))""",
)
def _(t):
    return cv.join_coverage(t.notes, t.admissions, t.diagnoses)


@query(
    "version_reconciliation",
    """SELECT *, n_notes_missing_from_hosp / greatest(n_notes, 1) * 100.0::DOUBLE
        AS pct_notes_missing_from_hosp FROM (SELECT
      count(*) FILTER (n = 1) AS n_notes, count(*) FILTER (a = 1) AS n_admissions,
      count(*) FILTER (n = 1 AND a = 1) AS n_intersection,
      count(*) FILTER (n = 1 AND a = 0) AS n_notes_missing_from_hosp FROM keys)""",
)
def _(t):
    return cv.version_reconciliation(t.notes, t.admissions)


_COVERAGE = """SELECT *, n_retained / greatest(n_notes, 1) * 100.0::DOUBLE AS pct_retained,
      n_drift_loss / greatest(n_notes, 1) * 100.0::DOUBLE AS pct_drift_loss,
      n_cohort_filter_loss / greatest(n_notes, 1) * 100.0::DOUBLE AS pct_cohort_filter_loss
    FROM (SELECT count(*) FILTER (n = 1) AS n_notes, count(*) FILTER (a = 1) AS n_admissions_full,
      count(*) FILTER (d = 1) AS n_admissions_cohort, count(*) FILTER (n = 1 AND d = 1) AS n_retained,
      count(*) FILTER (n = 1 AND a = 0) AS n_drift_loss,
      count(*) FILTER (n = 1 AND a = 1 AND d = 0) AS n_cohort_filter_loss FROM keys)"""


@query("cohort_coverage", _COVERAGE)
def _(t):
    return cv.cohort_coverage(t.notes, t.admissions, t.coded)


@query(
    "total_cohort_loss",
    f"""SELECT n_drift_loss + n_cohort_filter_loss AS total_missing,
      (n_drift_loss + n_cohort_filter_loss) / greatest(n_notes, 1) * 100.0::DOUBLE AS pct_missing
      FROM ({_COVERAGE})""",
)
def _(t):
    return cv.total_cohort_loss(cv.cohort_coverage(t.notes, t.admissions, t.coded))


@query(
    "set_difference_keys",
    "SELECT hadm_id FROM notes EXCEPT SELECT hadm_id FROM diagnoses WHERE icd_version = 10",
)
def _(t):
    return cv.set_difference_keys(t.notes, t.coded)


@query("set_intersect_keys", "SELECT hadm_id FROM notes INTERSECT SELECT hadm_id FROM admissions")
def _(t):
    return cv.set_intersect_keys(t.notes, t.admissions)


@query(
    "join_split_manifest",
    """SELECT s.hadm_id, s.note_id, split, count(icd_code) AS n_labels
       FROM silver s JOIN manifest USING (hadm_id) LEFT JOIN cohort_cells USING (hadm_id)
       GROUP BY s.hadm_id, s.note_id, split""",
)
def _(t):
    notes = silver_keys(t)
    codes = cv.restrict_codes_to_cohort(filter_code_version(t.diagnoses), notes)
    cells = lb.label_cells(codes, lb.top_k_codes(codes, TOP_K))
    per = cells.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n_labels"))
    placed = sp.join_split_manifest(notes, sp.patient_split(notes))
    n_labels = F.coalesce("n_labels", F.lit(0)).alias("n_labels")
    return placed.join(per, "hadm_id", "left").select("hadm_id", "note_id", "split", n_labels)


@query("join_pred_truth", "SELECT hadm_id, icd_code, prob, y FROM scored")
def _(t):
    return sc.join_pred_truth(t.predictions, t.truth)


@query(
    "dataset_funnel",
    f"""SELECT stage_no, stage, n, coalesce(lag(n) OVER (ORDER BY stage_no) - n, 0) AS loss FROM (
      SELECT 0 AS stage_no, 'raw_notes' AS stage, count(*) AS n FROM notes
      UNION ALL SELECT 1, 'with_admission', count(*) FROM notes
        WHERE hadm_id IN (SELECT hadm_id FROM admissions)
      UNION ALL SELECT 2, 'with_code_version', count(*) FROM notes
        WHERE hadm_id IN (SELECT hadm_id FROM admissions) AND hadm_id IN (SELECT hadm_id FROM codes)
      UNION ALL SELECT 3, 'min_tokens', count(*) FROM notes
        WHERE hadm_id IN (SELECT hadm_id FROM admissions) AND hadm_id IN (SELECT hadm_id FROM codes)
        AND {tokens()} >= {MIN_TOKENS})""",
)
def _(t):
    return cv.dataset_funnel(t.texts, t.admissions, t.diagnoses, VERSION, MIN_TOKENS)
