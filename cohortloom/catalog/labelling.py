"""Labels and splits."""

from pyspark.sql import functions as F

from cohortloom.catalog.coverage import silver, silver_keys
from cohortloom.catalog.registry import TOP_K, query
from cohortloom.operators import coverage as cv
from cohortloom.operators import labels as lb
from cohortloom.operators import splits as sp
from cohortloom.operators.curate import filter_code_version
from cohortloom.session import cut_lineage


def cohort(t):
    """The coded cohort, written down since labels and splits read it several times."""
    return cut_lineage(
        cv.restrict_to_coded_cohort(silver(t), t.diagnoses).select("hadm_id", "subject_id"), "cohort"
    )


def target(t):
    notes = cohort(t)
    return notes, lb.build_labels(notes, t.diagnoses, TOP_K)


@query("top_k_codes", "SELECT label_idx, icd_code FROM cohort_labels")
def _(t):
    codes = cv.restrict_codes_to_cohort(filter_code_version(t.diagnoses), silver(t))
    return lb.top_k_codes(codes, TOP_K)


@query("build_label_matrix", "SELECT hadm_id, icd_code, present FROM cohort_matrix")
def _(t):
    notes, labels = target(t)
    return lb.build_label_matrix(notes, labels.cells, labels.labels)


@query(
    "label_vectors",
    """SELECT hadm_id, string_agg(CAST(present AS VARCHAR), '' ORDER BY label_idx) AS bits
       FROM cohort_matrix GROUP BY hadm_id""",
)
def _(t):
    notes, labels = target(t)
    vectors = lb.label_vectors(notes, labels.cells, TOP_K)
    return vectors.select("hadm_id", F.array_join(F.col("y").cast("array<string>"), "").alias("bits"))


@query("build_labels", "SELECT hadm_id, label_idx, icd_code FROM cohort_cells")
def _(t):
    return target(t)[1].cells


_DENSITY = """SELECT count(DISTINCT hadm_id) AS n_admissions, CAST(sum(present) AS BIGINT) AS n_positive,
   sum(present) / count(*) AS density FROM cohort_matrix"""


@query("label_density", _DENSITY)
def _(t):
    notes, labels = target(t)
    return lb.label_density(notes, labels.cells, TOP_K)


@query(
    "zero_label_count",
    "SELECT count(*) AS n_zero_label FROM cohort WHERE hadm_id NOT IN (SELECT hadm_id FROM cohort_cells)",
)
def _(t):
    notes, labels = target(t)
    return lb.zero_label_count(notes, labels.cells)


@query(
    "check_alignment",
    """SELECT count(*) FILTER (hadm_id NOT IN (SELECT hadm_id FROM cohort_cells)) AS notes_without_labels,
       (SELECT count(DISTINCT hadm_id) FROM cohort_cells WHERE hadm_id NOT IN (SELECT hadm_id FROM cohort))
       AS labels_without_notes FROM cohort""",
)
def _(t):
    notes, labels = target(t)
    lb.check_alignment(notes, lb.label_vectors(notes, labels.cells, TOP_K))
    return lb.alignment(notes, labels.cells)


@query("patient_split", "SELECT hadm_id, subject_id, split FROM manifest")
def _(t):
    return sp.patient_split(silver_keys(t))


@query(
    "split_disjoint_check",
    """SELECT subject_id, count(*) AS n_rows FROM manifest GROUP BY subject_id
       HAVING count(DISTINCT split) > 1""",
)
def _(t):
    return sp.split_disjoint_check(sp.patient_split(silver_keys(t)))


@query(
    "split_disjoint_check_leaks",
    """SELECT subject_id, count(*) AS n_rows FROM (SELECT subject_id,
         CASE WHEN md5('42:' || hadm_id) < '8' THEN 'train' ELSE 'test' END AS split FROM silver)
       GROUP BY subject_id HAVING count(DISTINCT split) > 1""",
)
def _(t):
    # a manifest that was cut by admission instead of by subject does leak
    by_admission = F.when(sp._hash(42, "hadm_id") < "8", "train").otherwise("test")
    leaky = silver(t).select("hadm_id", "subject_id", by_admission.alias("split"))
    return sp.split_disjoint_check(leaky)


@query(
    "split_counts",
    """SELECT split, count(DISTINCT subject_id) AS n_patients, count(*) AS n_admissions
       FROM manifest GROUP BY split""",
)
def _(t):
    return sp.split_counts(sp.patient_split(silver_keys(t)))


@query(
    "label_coverage_report",
    """SELECT icd_code AS label, avg(present) FILTER (split = 'train') AS train_pct,
       avg(present) FILTER (split = 'val') AS val_pct, avg(present) FILTER (split = 'test') AS test_pct
       FROM cohort_matrix JOIN manifest USING (hadm_id) GROUP BY icd_code""",
)
def _(t):
    notes, labels = target(t)
    vectors = lb.label_vectors(notes, labels.cells, TOP_K)
    return sp.label_coverage_report(vectors, sp.patient_split(silver_keys(t)), lb.label_list(labels.labels))
