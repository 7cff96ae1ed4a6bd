"""Profiling reports over tables, notes, codes, patients and admissions.

Group keys that are null are dropped unless a report says otherwise. Shares are unrounded unless a
number of digits is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.codes import NOT_IN_DICTIONARY, default_description, format_code
from cohortloom.functions.numbers import (
    AGE_LABELS,
    age_bucket,
    clip_upper,
    length_of_stay,
    numeric_coerce,
    parse_ts_coerce,
    percent,
)
from cohortloom.functions.text import char_length, count_deid_markers, token_length
from cohortloom.operators import coverage
from cohortloom.operators.curate import dedup_dictionary, filter_code_version, sample_fixed_n
from cohortloom.operators.ordered import moments_of, quantile_row, quantiles_of, ranked, value_counts
from cohortloom.operators.tables import restrict, rows_of, top
from cohortloom.session import cut_lineage, small_side

# What the length report shows, the token caps and the code counts it is asked for.
LENGTH_QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
TOKEN_CAPS = (512, 1024, 2048, 4096)
COVERAGE_K = (10, 25, 50, 100, 250, 500, 1000)



def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row tables side by side, each as scalar subqueries of the first."""
    first, *rest = parts
    for part in rest:
        first = first.select("*", *[part.select(c).scalar().alias(c) for c in part.columns])
    return first


# -- tables ------------------------------------------------------------------------------------


def _value_bytes(field: T.StructField) -> Column:
    """Bytes a value takes: text by its encoding, the rest by its type."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(field.name)).cast("bigint"), F.lit(0))
    widths = {"boolean": 1, "byte": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    return F.lit(widths.get(field.dataType.simpleString(), 8)).cast("bigint")


def summarize_volumetrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and megabytes of data per table, each in one pass."""
    parts = []
    for name, df in tables.items():
        size = reduce(lambda a, b: a + b, [_value_bytes(f) for f in df.schema.fields])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).select(
                F.lit(name).alias("table"),
                "rows",
                F.lit(len(df.columns)).cast("bigint").alias("columns"),
                F.round(F.coalesce("bytes", F.lit(0)) / F.lit(1e6), 2).alias("memory_mb"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def null_rate_by_column(df: DataFrame, table: str) -> DataFrame:
    """Nulls (and NaNs) per column, all columns in one pass."""

    def missing(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return column.isNull() | F.isnan(column)
        return column.isNull()

    fields = df.schema.fields
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(missing(f)).alias(f"_{i}") for i, f in enumerate(fields)],
    )
    cells = [
        F.struct(
            F.lit(table).alias("table"),
            F.lit(f.name).alias("column"),
            F.col(f"_{i}").alias("nulls"),
            (F.col(f"_{i}") / F.when(F.col("_n") > 0, F.col("_n"))).alias("null_rate"),
        )
        for i, f in enumerate(fields)
    ]
    report = counted.select(F.inline(F.array(*cells)))
    return report.orderBy(F.desc("null_rate"), "column")


def date_range(df: DataFrame, column: str) -> DataFrame:
    """Earliest, latest, whole days between them and number of readable timestamps."""
    ts = parse_ts_coerce(F.col(column))
    found = df.agg(
        F.min(ts).alias("min"), F.max(ts).alias("max"), F.count(ts).alias("n_non_null")
    )
    days = F.floor((F.unix_micros("max") - F.unix_micros("min")) / F.lit(86_400_000_000))
    return found.select(
        "min", "max", F.coalesce(days, F.lit(0)).cast("bigint").alias("span_days"), "n_non_null"
    )


# -- notes -------------------------------------------------------------------------------------


def note_type_distribution(notes: DataFrame, digits: int | None = None) -> DataFrame:
    """Notes per type; notes without a type are a type of their own."""
    counts = notes.groupBy("note_type").agg(F.count(F.lit(1)).alias("count"))
    total = notes.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", percent(F.col("count"), total, digits)).orderBy(
        F.desc("count"), "note_type"
    )


def length_percentiles(
    lengths: DataFrame, quantiles: Sequence[float] = LENGTH_QUANTILES
) -> DataFrame:
    """Minimum, quantiles, maximum, mean and deviation of both lengths, one row per statistic."""
    metrics = ["n_tokens", "n_chars"]
    counts = value_counts(lengths, metrics)
    found = moments_of(counts).join(quantiles_of(counts, quantiles), "metric")
    names = {f"p{int(q * 100):02d}": f"q{i}" for i, q in enumerate(quantiles)}
    cells = {name: name for name in ("min", "max", "mean", "std")} | names
    tall = found.select(
        "metric",
        F.inline(F.array(*[F.struct(F.lit(n).alias("pct"), F.col(c).alias("value")) for n, c in cells.items()])),
    )
    return tall.groupBy("pct").pivot("metric", metrics).agg(F.first("value"))


def truncation_impact(lengths: DataFrame, caps: Sequence[int] = TOKEN_CAPS) -> DataFrame:
    """Notes longer than each token cap, and the median of what the cap cuts off."""
    counts = cut_lineage(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    over = F.col("n_tokens") - F.col("max_tokens")
    # every cap sees the merged counts, not the notes
    capped = counts.select("n_tokens", "n", F.explode(F.array(*[F.lit(cap) for cap in caps])).alias("max_tokens"))
    per_cap = capped.groupBy("max_tokens").agg(
        F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(over > 0, F.col("n"))), F.lit(0)).alias("n_exceeds")
    )
    exceeding = capped.filter(over > 0).select(F.col("max_tokens").alias("metric"), over.cast("double").alias("v"), "n")
    medians = quantiles_of(exceeding, [0.5])
    medians = medians.select(F.col("metric").alias("max_tokens"), F.col("q0").alias("median_excess"))
    joined = per_cap.join(small_side(medians), "max_tokens", "left")
    return joined.select(
        "max_tokens",
        "n_total",
        "n_exceeds",
        percent(F.col("n_exceeds"), F.col("n_total")).alias("pct_exceeds"),
        F.coalesce("median_excess", F.lit(0.0)).alias("median_tokens_lost_for_exceeders"),
    )


def marker_counts(notes: DataFrame) -> DataFrame:
    """Redaction markers, characters and tokens of each note, ``(markers, n_chars, n_tokens)``."""
    text = F.col("text")
    return notes.select(
        count_deid_markers(text).cast("bigint").alias("markers"),
        char_length(text).cast("bigint").alias("n_chars"),
        token_length(text).cast("bigint").alias("n_tokens"),
    )


def deid_marker_stats(notes: DataFrame, sample_size: int | None = None, seed: int = 0) -> DataFrame:
    """How dense redaction markers are, per note and per unit of text; of all notes, or of a sample."""
    return marker_stats_of(marker_counts(sample_fixed_n(notes, sample_size, seed)))


def marker_stats_of(measured: DataFrame) -> DataFrame:
    """``deid_marker_stats`` of measured notes, read once and merged by number of markers."""
    n, markers = F.col("n"), F.col("markers")
    merged = measured.groupBy("markers").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum("n_tokens").alias("tokens")
    )
    merged = cut_lineage(merged, "marker-counts")
    sums = merged.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("sample_size"),
        F.coalesce(F.sum(markers * n), F.lit(0)).alias("total_markers"),
        F.try_divide(F.sum(markers * n), F.sum(n)).alias("mean_markers_per_note"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("_chars"),
    )
    values = merged.select(F.lit("markers").alias("metric"), markers.cast("double").alias("v"), "n")
    sums = _one_row([sums, quantiles_of(values, [0.5]).select(F.col("q0").alias("median_markers_per_note"))])

    def per(unit: int, total: str) -> Column:
        return F.col("total_markers") / F.greatest(F.col(total) / F.lit(float(unit)), F.lit(1.0))

    return sums.select(
        "sample_size",
        "total_markers",
        "mean_markers_per_note",
        "median_markers_per_note",
        per(1000, "_tokens").alias("markers_per_1000_tokens"),
        per(10000, "_chars").alias("markers_per_10000_chars"),
    )


def note_duplication_summary(notes: DataFrame) -> DataFrame:
    """Repeated note ids and admissions with several notes."""
    has_seq = "note_seq" in notes.columns
    seq = F.max("note_seq").cast("bigint") if has_seq else F.lit(-1).cast("bigint")
    by_note = notes.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))
    by_admission = notes.filter("hadm_id IS NOT NULL").groupBy("hadm_id")
    by_admission = by_admission.agg(F.count(F.lit(1)).alias("n"))
    notes_row = by_note.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_notes"),
        F.count("note_id").alias("unique_note_id"),
    ).withColumn("duplicate_note_id", F.col("n_notes") - F.col("unique_note_id"))
    admissions_row = by_admission.agg(
        F.count(F.lit(1)).alias("unique_hadm_id"),
        F.count_if(F.col("n") > 1).alias("admissions_with_multiple_notes"),
        F.max("n").alias("max_notes_per_hadm"),
    )
    return _one_row([notes_row, admissions_row, notes.agg(seq.alias("max_note_seq"))])


# -- codes -------------------------------------------------------------------------------------


def icd_version_distribution(diagnoses: DataFrame) -> DataFrame:
    """Code rows and admissions per code version."""
    per_admission = (
        diagnoses.filter("icd_version IS NOT NULL")
        .groupBy("icd_version", "hadm_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_admission.groupBy("icd_version").agg(
        F.sum("n").alias("n_codes"), F.count("hadm_id").alias("n_admissions")
    )


def icd_version_by_year(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Code rows per admission year and version.

    Rows are merged per admission before the join, so an admission with very many codes joins as
    one row.
    """
    merged = (
        diagnoses.filter("icd_version IS NOT NULL")
        .groupBy("hadm_id", "icd_version")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dated = coverage.join_admission_year(merged, admissions).filter("year IS NOT NULL")
    yearly = dated.groupBy("year", "icd_version").agg(F.sum("n").alias("n_codes"))
    return yearly.orderBy("year", "icd_version")


def version_year_pivot(by_year: DataFrame, versions: Sequence[int] = (9, 10)) -> DataFrame:
    """Years as rows, versions as columns ``v9, v10``, missing cells 0."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("icd_version") == v, F.col("n_codes"))), F.lit(0)).alias(f"v{v}")
        for v in versions
    ]
    return by_year.groupBy("year").agg(*cells).orderBy("year")


def code_counts(diagnoses: DataFrame, version: int = 10) -> DataFrame:
    """Rows and admissions per normalised code."""
    per_admission = (
        filter_code_version(diagnoses, version)
        .groupBy("icd_code", "hadm_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_admission.groupBy("icd_code").agg(
        F.sum("n").alias("n_codes"), F.count("hadm_id").alias("n_admissions")
    )


def icd_frequency(diagnoses: DataFrame, version: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Code counts with the rank by rows, ties by code; of given ``code_counts``, if several reports share them."""
    return ranked(counts or code_counts(diagnoses, version), [F.desc("n_codes"), F.col("icd_code")])


def top_frequency(
    diagnoses: DataFrame, k: int, version: int = 10, counts: DataFrame | None = None
) -> DataFrame:
    """The ``k`` most frequent codes with their rank."""
    first = top(counts or code_counts(diagnoses, version), [F.desc("n_codes"), F.col("icd_code")], k)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("n_codes"), F.col("icd_code"))
    return first.withColumn("rank", F.row_number().over(order))  # k rows


def coded_admissions(diagnoses: DataFrame, version: int = 10) -> DataFrame:
    """One-row count of admissions with a code of the version."""
    at_version = diagnoses.filter(F.col("icd_version") == version)
    return at_version.agg(F.count_distinct("hadm_id").alias("n"))


def top_k_coverage(
    diagnoses: DataFrame,
    k_list: Sequence[int] = COVERAGE_K,
    version: int = 10,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Admissions with at least one of the top ``k`` codes, for every ``k`` in one pass."""
    ranks = top_frequency(diagnoses, max(k_list), version, counts).select("icd_code", "rank")
    codes = filter_code_version(diagnoses, version)
    best = (
        codes.join(small_side(ranks), "icd_code", "left")
        .filter("hadm_id IS NOT NULL")
        .groupBy("hadm_id")
        .agg(F.min("rank").alias("rank"))
    )
    counted = best.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in k_list],
    )
    cells = [
        F.struct(
            F.lit(k).alias("k"),
            F.col(f"_{k}").alias("n_admissions_covered"),
            percent(F.col(f"_{k}"), F.col("_n")).alias("pct_admissions_covered"),
        )
        for k in k_list
    ]
    return counted.select(F.inline(F.array(*cells)))


def join_code_titles(frequency: DataFrame, dictionary: DataFrame, version: int = 10) -> DataFrame:
    """Code rows with their title, null where the dictionary has none."""
    return frequency.join(dedup_dictionary(dictionary, version), "icd_code", "left")


def top_code_table(
    diagnoses: DataFrame,
    dictionary: DataFrame,
    k: int = 50,
    version: int = 10,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The report of the most frequent codes: display form, title, admissions and their share."""
    titled = join_code_titles(top_frequency(diagnoses, k, version, counts), dictionary, version)
    total = coded_admissions(diagnoses, version).scalar()
    return titled.select(
        "rank",
        format_code(F.col("icd_code")).alias("code"),
        default_description(F.col("long_title"), NOT_IN_DICTIONARY).alias("description"),
        "n_admissions",
        percent(F.col("n_admissions"), total).alias("pct_of_cohort"),
    ).orderBy("rank")


def codes_per_admission(diagnoses: DataFrame, version: int = 10) -> DataFrame:
    """Distinct codes, as they are written, per admission."""
    at_version = diagnoses.filter((F.col("icd_version") == version) & F.col("hadm_id").isNotNull())
    return at_version.groupBy("hadm_id").agg(F.count_distinct("icd_code").alias("n_codes"))


def codes_per_admission_stats(per_admission: DataFrame) -> DataFrame:
    s = F.col("n_codes")
    plain = per_admission.agg(
        F.min(s).alias("min"), F.avg(s).alias("mean"), F.max(s).alias("max"),
        F.count(F.lit(1)).alias("n_admissions"),
    )
    wanted = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return _one_row([plain, quantile_row(per_admission, "n_codes", wanted)])


# -- patients and admissions -------------------------------------------------------------------


def patient_demographics(patients: DataFrame, digits: int | None = None) -> DataFrame:
    """Patients per gender (missing is a bucket) and per age bucket (empty ones included).

    The share of a gender is of all patients, that of an age of those within some bucket.
    """
    parts = []
    if "gender" in patients.columns:
        counts = patients.groupBy("gender").agg(F.count(F.lit(1)).alias("n"))
        total = patients.agg(F.count(F.lit(1))).scalar()
        parts.append(
            counts.select(
                F.lit("gender").alias("dimension"),
                F.coalesce("gender", F.lit("nan")).alias("bucket"),
                "n",
                percent(F.col("n"), total, digits).alias("pct"),
            )
        )
    if "anchor_age" in patients.columns:
        bucketed = patients.select(age_bucket(F.col("anchor_age")).alias("bucket"))
        counted = bucketed.agg(
            F.count("bucket").alias("_n"),
            *[F.count_if(F.col("bucket") == b).alias(f"_{i}") for i, b in enumerate(AGE_LABELS)],
        )
        cells = [
            F.struct(
                F.lit("age_bucket").alias("dimension"),
                F.lit(b).alias("bucket"),
                F.col(f"_{i}").alias("n"),
                percent(F.col(f"_{i}"), F.col("_n"), digits).alias("pct"),
            )
            for i, b in enumerate(AGE_LABELS)
        ]
        parts.append(counted.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def admissions_per_patient(admissions: DataFrame) -> DataFrame:
    known = admissions.filter("subject_id IS NOT NULL")
    return known.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_admissions"))


def admissions_per_patient_stats(per_patient: DataFrame) -> DataFrame:
    s = F.col("n_admissions")
    plain = per_patient.agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.min(s).alias("min"),
        F.avg(s).alias("mean"),
        F.max(s).alias("max"),
        F.count_if(s == 1).alias("patients_with_single_admission"),
        F.count_if(s >= 5).alias("patients_with_5plus_admissions"),
    )
    quantiles = quantile_row(per_patient, "n_admissions", {"median": 0.5, "p95": 0.95})
    return _one_row([plain, quantiles])


def multi_admission_share(per_patient: DataFrame) -> DataFrame:
    """Percentage of patients with more than one admission."""
    counted = per_patient.agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(F.col("n_admissions") > 1).alias("n_multi"),
    )
    return counted.withColumn("pct_multi", percent(F.col("n_multi"), F.col("n_patients")))


def with_length_of_stay(admissions: DataFrame) -> DataFrame:
    admitted, discharged = (parse_ts_coerce(F.col(c)) for c in ("admittime", "dischtime"))
    return admissions.withColumn("los_days", length_of_stay(admitted, discharged))


def los_summary(admissions: DataFrame) -> DataFrame:
    """Median, mean and 95th percentile of the length of stay in days."""
    stays = with_length_of_stay(admissions).select("los_days")
    mean = stays.agg(F.avg("los_days").alias("mean"))
    return _one_row([mean, quantile_row(stays, "los_days", {"median": 0.5, "p95": 0.95})])


def mortality_rate(admissions: DataFrame, digits: int | None = None) -> DataFrame:
    """Share of admissions whose flag says the patient died."""
    n = F.count(F.lit(1)).alias("n_admissions")
    if "hospital_expire_flag" not in admissions.columns:
        return admissions.agg(n).select(
            "n_admissions",
            F.lit(None).cast("bigint").alias("n_deaths"),
            F.lit(None).cast("double").alias("rate"),
        )
    died = numeric_coerce(F.col("hospital_expire_flag")) == 1
    counted = admissions.agg(n, F.count_if(died).alias("n_deaths"))
    rate = F.col("n_deaths") / F.greatest(F.col("n_admissions"), F.lit(1))
    return counted.withColumn("rate", rate if digits is None else F.round(rate, digits))


def cohort_demographics(
    notes: DataFrame,
    admissions: DataFrame,
    diagnoses: DataFrame,
    patients: DataFrame,
    version: int = 10,
) -> DataFrame:
    """Demographics of the modelable cohort, then its admissions per patient as further rows."""
    inside = coverage.cohort_admissions(notes, admissions, diagnoses, version)
    inside = cut_lineage(inside.select("subject_id"), "cohort-subjects")
    people = restrict(patients.select("subject_id", "gender", "anchor_age"), inside, "subject_id")
    who = patient_demographics(cut_lineage(people, "cohort-people"))
    stats = admissions_per_patient_stats(admissions_per_patient(inside))
    names = stats.columns
    tall = rows_of(stats, "bucket", "value", {c: F.col(c).cast("double") for c in names})
    return who.select(
        "dimension", "bucket", F.col("n").cast("double").alias("value"), "pct"
    ).unionByName(
        tall.select(
            F.lit("admissions_per_patient").alias("dimension"),
            "bucket",
            "value",
            F.lit(None).cast("double").alias("pct"),
        )
    )


# -- data behind the figures -------------------------------------------------------------------


def equal_width_histogram(df: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """Rows per bin of equal width between minimum and maximum, the last bin closed."""
    v = F.col(column).cast("double")
    bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    low, high = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    span = F.when(high > low, high - low)
    place = F.least(F.floor((v - low) * F.lit(bins) / span), F.lit(bins - 1))
    binned = df.filter(v.isNotNull()).select(F.coalesce(place, F.lit(0)).cast("int").alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def capped_histogram(df: DataFrame, column: str, cap: int) -> DataFrame:
    """Rows per integer value, values above the cap counted at the cap."""
    capped = df.select(clip_upper(F.col(column), cap).cast("int").alias("bin"))
    return capped.filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
