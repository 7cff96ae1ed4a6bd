"""How the key sets of several tables overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numbers import percent, year_of
from cohortloom.functions.text import token_length
from cohortloom.operators.tables import distinct_keys, restrict, rows_of

KEY = "hadm_id"


def membership(key: str = KEY, **tables: DataFrame) -> DataFrame:
    """One row per key with a flag per table.

    The tables are stacked and merged by key: one shuffle of keys alone for any number of tables,
    and a key that fills a third of a table is one row per task by then.
    """
    names = list(tables)
    marked = [
        df.select(F.col(key), *[F.lit(name == other).alias(other) for other in names])
        for name, df in tables.items()
    ]
    stacked = reduce(DataFrame.unionByName, marked).filter(F.col(key).isNotNull())
    return stacked.groupBy(key).agg(*[F.bool_or(name).alias(name) for name in names])


def _at_version(diagnoses: DataFrame, version: int) -> DataFrame:
    return diagnoses.filter(F.col("icd_version") == version)


def restrict_to_coded_cohort(notes: DataFrame, diagnoses: DataFrame, version: int = 10) -> DataFrame:
    """Notes of admissions with at least one code of the version."""
    return restrict(notes, _at_version(diagnoses, version), KEY)


def restrict_codes_to_cohort(codes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Codes of admissions in the cohort."""
    return restrict(codes, cohort, KEY)


def join_admission_year(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Diagnoses with the year of their admission, null where there is none."""
    years = admissions.select(KEY, year_of(F.col("admittime")).alias("year"))
    return diagnoses.join(years, KEY, "left")


def cohort_admissions(
    notes: DataFrame, admissions: DataFrame, diagnoses: DataFrame, version: int = 10
) -> DataFrame:
    """Admissions that have a note and a code of the version."""
    with_note = restrict(admissions, notes, KEY)
    return restrict(with_note, _at_version(diagnoses, version), KEY)


def cohort_three_way(
    notes: DataFrame,
    admissions: DataFrame,
    diagnoses: DataFrame,
    patients: DataFrame,
    version: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admissions, subjects and patients of the cohort."""
    inside = cohort_admissions(notes, admissions, diagnoses, version)
    subjects = distinct_keys(inside, "subject_id")
    return inside, subjects, restrict(patients, inside, "subject_id")


def join_coverage(
    notes: DataFrame, admissions: DataFrame, diagnoses: DataFrame, version: int = 10
) -> DataFrame:
    """Sizes of the seven regions and the three sets of a Venn diagram, one row each."""
    flags = membership(notes=notes, adm=admissions, dx=_at_version(diagnoses, version))
    n, a, d = F.col("notes"), F.col("adm"), F.col("dx")
    regions = {
        "notes_only": n & ~a & ~d,
        "adm_only": a & ~n & ~d,
        "dx_only": d & ~n & ~a,
        "notes_and_adm": n & a & ~d,
        "notes_and_dx": n & d & ~a,
        "adm_and_dx": a & d & ~n,
        "all_three": n & a & d,
        "total_notes": n,
        "total_adm": a,
        f"total_dx_v{version}": d,
    }
    counted = flags.agg(*[F.count_if(test).alias(name) for name, test in regions.items()])
    return rows_of(counted, "slice", "count", {name: F.col(name) for name in regions})


def version_reconciliation(
    notes: DataFrame, admissions: DataFrame, digits: int | None = None
) -> DataFrame:
    """Admissions with notes that the admissions table lacks."""
    flags = membership(notes=notes, adm=admissions)
    n, a = F.col("notes"), F.col("adm")
    counts = flags.agg(
        F.count_if(n).alias("n_notes"),
        F.count_if(a).alias("n_admissions"),
        F.count_if(n & a).alias("n_intersection"),
        F.count_if(n & ~a).alias("n_notes_missing_from_hosp"),
    )
    missing = percent(F.col("n_notes_missing_from_hosp"), F.col("n_notes"), digits)
    return counts.withColumn("pct_notes_missing_from_hosp", missing)


def cohort_coverage(
    notes: DataFrame, admissions: DataFrame, cohort: DataFrame, digits: int | None = None
) -> DataFrame:
    """Split the loss of notes into drift (no admission) and the cohort filter."""
    flags = membership(notes=notes, adm=admissions, cohort=cohort)
    n, a, c = F.col("notes"), F.col("adm"), F.col("cohort")
    counts = flags.agg(
        F.count_if(n).alias("n_notes"),
        F.count_if(a).alias("n_admissions_full"),
        F.count_if(c).alias("n_admissions_cohort"),
        F.count_if(n & c).alias("n_retained"),
        F.count_if(n & ~a).alias("n_drift_loss"),
        F.count_if(n & a & ~c).alias("n_cohort_filter_loss"),
    )
    shares = {
        f"pct_{part}": percent(F.col(f"n_{part}"), F.col("n_notes"), digits)
        for part in ("retained", "drift_loss", "cohort_filter_loss")
    }
    return counts.withColumns(shares)


def total_cohort_loss(coverage: DataFrame, digits: int | None = None) -> DataFrame:
    """Both losses of ``cohort_coverage`` together."""
    lost = F.col("n_drift_loss") + F.col("n_cohort_filter_loss")
    return coverage.select(
        lost.alias("total_missing"), percent(lost, F.col("n_notes"), digits).alias("pct_missing")
    )


def set_difference_keys(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct non-null keys of the left table that the right one lacks."""
    return distinct_keys(left, key).join(distinct_keys(right, key), key, "left_anti")


def set_intersect_keys(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct non-null keys that both tables have."""
    return restrict(distinct_keys(left, key), right, key)


def dataset_funnel(
    notes: DataFrame,
    admissions: DataFrame,
    diagnoses: DataFrame,
    version: int = 10,
    min_tokens: int = 100,
) -> DataFrame:
    """Notes left after each cohort stage, and the loss against the stage before.

    Tokens are counted where the text is read; only keys and flags are shuffled.
    """
    long_enough = token_length(F.col("text")) >= min_tokens
    true, false = F.lit(True), F.lit(False)

    def marked(df: DataFrame, rows: Column, kept: Column, adm: Column, dx: Column) -> DataFrame:
        return df.select(
            KEY, rows.alias("rows"), kept.alias("kept"), adm.alias("adm"), dx.alias("dx")
        )

    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    stacked = (
        marked(notes, one, F.when(long_enough, one).otherwise(none), false, false)
        .unionByName(marked(distinct_keys(admissions, KEY), none, none, true, false))
        .unionByName(
            marked(distinct_keys(_at_version(diagnoses, version), KEY), none, none, false, true)
        )
    )
    merged = stacked.groupBy(KEY).agg(
        F.sum("rows").alias("rows"),
        F.sum("kept").alias("kept"),
        F.bool_or("adm").alias("adm"),
        F.bool_or("dx").alias("dx"),
    )
    adm, dx = F.col("adm"), F.col("dx")
    stages = {
        "raw_notes": F.col("rows"),
        "with_admission": F.when(adm, F.col("rows")),
        "with_code_version": F.when(adm & dx, F.col("rows")),
        "min_tokens": F.when(adm & dx, F.col("kept")),
    }
    sums = merged.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in stages.items()])
    names = list(stages)
    cells = [
        F.struct(
            F.lit(i).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(name).alias("n"),
            (F.col(names[i - 1]) - F.col(name) if i else F.lit(0).cast("bigint")).alias("loss"),
        )
        for i, name in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*cells)))
