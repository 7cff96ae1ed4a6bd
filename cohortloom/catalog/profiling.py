"""The profiling suite."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query
from cohortloom.operators import profile as pf
from cohortloom.operators.curate import compute_lengths
from cohortloom.operators.labels import label_cooccurrence


def lengths(t):
    return compute_lengths(t.texts).select("note_id", "n_tokens", "n_chars")


_VOLUME = """SELECT '{name}' AS "table", count(*) AS rows, CAST({width} AS BIGINT) AS columns,
  round(coalesce(sum({size}), 0) / 1e6, 2) AS memory_mb FROM {name}"""


def _size(*texts, fixed=0):
    return " + ".join([*[f"coalesce(strlen({c}), 0)" for c in texts], str(fixed)])


@query(
    "summarize_volumetrics",
    " UNION ALL ".join(
        _VOLUME.format(name=n, width=w, size=s)
        for n, w, s in [
            ("notes", 6, _size("note_id", "note_type", "text", fixed=20)),
            ("diagnoses", 5, _size("icd_code", fixed=24)),
            ("admissions", 5, _size(fixed=36)),
            ("patients", 5, _size("gender", "anchor_year_group", fixed=16)),
            ("dictionary", 3, _size("icd_code", "long_title", fixed=4)),
        ]
    ),
)
def _(t):
    names = ("notes", "diagnoses", "admissions", "patients", "dictionary")
    return pf.summarize_volumetrics({n: getattr(t, n) for n in names})


# titles of the codes in use: the dictionary is incomplete, so some are missing
_TITLED = """SELECT d.icd_code, d.hadm_id, long_title FROM diagnoses d LEFT JOIN titles t
  ON t.icd_code = upper(trim(d.icd_code))"""


@query(
    "null_rate_by_column",
    f"""WITH titled AS ({_TITLED}) SELECT 'titled' AS "table", c AS "column",
      n AS nulls, n / (SELECT count(*) FROM titled) AS null_rate FROM (
      SELECT 'icd_code' AS c, count(*) - count(icd_code) AS n FROM titled
      UNION ALL SELECT 'hadm_id', count(*) - count(hadm_id) FROM titled
      UNION ALL SELECT 'long_title', count(*) - count(long_title) FROM titled)""",
)
def _(t):
    from cohortloom.functions.codes import normalize_code
    from cohortloom.operators.curate import dedup_dictionary

    titles = dedup_dictionary(t.dictionary).withColumnRenamed("icd_code", "code")
    code = normalize_code(F.col("icd_code"))
    titled = t.diagnoses.join(titles, code == titles["code"], "left")
    return pf.null_rate_by_column(titled.select("icd_code", "hadm_id", "long_title"), "titled")


@query(
    "date_range",
    """SELECT 'admittime' AS "column", min(admittime) AS min, max(admittime) AS max,
      CAST(floor((epoch_us(max(admittime)) - epoch_us(min(admittime))) / 86400000000) AS BIGINT) AS span_days,
      count(admittime) AS n_non_null FROM admissions
      UNION ALL SELECT 'dischtime', min(dischtime), max(dischtime),
      CAST(floor((epoch_us(max(dischtime)) - epoch_us(min(dischtime))) / 86400000000) AS BIGINT),
      count(dischtime) FROM admissions""",
)
def _(t):
    parts = [
        pf.date_range(t.admissions, c).select(F.lit(c).alias("column"), "*")
        for c in ("admittime", "dischtime")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "note_type_distribution",
    """SELECT note_type, count(*) AS count, count(*) / (SELECT count(*) FROM notes) * 100.0::DOUBLE AS pct
      FROM notes GROUP BY note_type""",
)
def _(t):
    return pf.note_type_distribution(t.notes)


_STATS = [("min", "min({})"), ("max", "max({})"), ("mean", "avg({})"), ("std", "stddev_samp({})")] + [
    (f"p{int(q * 100):02d}", f"quantile_cont({{}}, {q})") for q in pf.LENGTH_QUANTILES
]


@query(
    "length_percentiles",
    " UNION ALL ".join(
        f"SELECT '{n}' AS pct, round(CAST({fn.format('n_tokens')} AS DOUBLE), 6) AS n_tokens, "
        f"round(CAST({fn.format('n_chars')} AS DOUBLE), 6) AS n_chars FROM lengths"
        for n, fn in _STATS
    ),
)
def _(t):
    rows = pf.length_percentiles(lengths(t))
    return rows.select("pct", *[F.round(c, 6).alias(c) for c in ("n_tokens", "n_chars")])


@query(
    "truncation_impact",
    """SELECT cap AS max_tokens, count(*) AS n_total, count(*) FILTER (n_tokens > cap) AS n_exceeds,
      count(*) FILTER (n_tokens > cap) / count(*) * 100.0::DOUBLE AS pct_exceeds,
      coalesce(median(n_tokens - cap) FILTER (n_tokens > cap), 0.0) AS median_tokens_lost_for_exceeders
      FROM lengths CROSS JOIN (VALUES (512), (1024), (2048), (4096)) AS v(cap) GROUP BY cap""",
)
def _(t):
    return pf.truncation_impact(lengths(t))


@query(
    "deid_marker_stats",
    r"""SELECT count(*) AS sample_size, CAST(sum(m) AS BIGINT) AS total_markers, avg(m) AS mean_markers_per_note,
      median(m) AS median_markers_per_note,
      sum(m) / greatest(sum(k) / 1000.0::DOUBLE, 1) AS markers_per_1000_tokens,
      sum(m) / greatest(sum(c) / 10000.0::DOUBLE, 1) AS markers_per_10000_chars
      FROM (SELECT len(regexp_extract_all(text, '_{2,}')) AS m, l.n_tokens AS k, l.n_chars AS c
        FROM notes JOIN lengths l USING (note_id))""",
)
def _(t):
    return pf.deid_marker_stats(t.texts, sample_size=None)


@query(
    "note_duplication_summary",
    """SELECT * FROM (SELECT count(*) AS n_notes, count(DISTINCT note_id) AS unique_note_id,
        count(*) - count(DISTINCT note_id) AS duplicate_note_id,
        count(DISTINCT hadm_id) AS unique_hadm_id, CAST(max(note_seq) AS BIGINT) AS max_note_seq FROM notes)
      CROSS JOIN (SELECT count(*) FILTER (n > 1) AS admissions_with_multiple_notes,
        max(n) AS max_notes_per_hadm FROM (SELECT hadm_id, count(*) AS n FROM notes GROUP BY hadm_id))""",
)
def _(t):
    return pf.note_duplication_summary(t.notes)


@query(
    "icd_version_distribution",
    """SELECT icd_version, count(*) AS n_codes, count(DISTINCT hadm_id) AS n_admissions
      FROM diagnoses GROUP BY icd_version""",
)
def _(t):
    return pf.icd_version_distribution(t.diagnoses)


_BY_YEAR = """SELECT CAST(year(admittime) AS INT) AS year, icd_version, count(*) AS n_codes
  FROM diagnoses JOIN admissions USING (hadm_id) GROUP BY 1, 2"""


@query("icd_version_by_year", _BY_YEAR)
def _(t):
    return pf.icd_version_by_year(t.diagnoses, t.admissions)


@query(
    "version_year_pivot",
    f"""SELECT year, CAST(coalesce(sum(n_codes) FILTER (icd_version = 9), 0) AS BIGINT) AS v9,
      CAST(coalesce(sum(n_codes) FILTER (icd_version = 10), 0) AS BIGINT) AS v10
      FROM ({_BY_YEAR}) GROUP BY year""",
)
def _(t):
    return pf.version_year_pivot(pf.icd_version_by_year(t.diagnoses, t.admissions))


@query("icd_frequency", "SELECT icd_code, n_codes, n_admissions, rank FROM frequency")
def _(t):
    return pf.icd_frequency(t.diagnoses)


_TOTAL = "(SELECT count(DISTINCT hadm_id) FROM codes)"


@query(
    "top_k_coverage",
    f"""SELECT k, count(DISTINCT hadm_id) AS n_admissions_covered,
      count(DISTINCT hadm_id) / {_TOTAL} * 100.0::DOUBLE AS pct_admissions_covered
      FROM codes JOIN frequency USING (icd_code)
      JOIN (VALUES (1), (2), (5), (10), (25), (50), (100), (250)) AS v(k) ON rank <= k GROUP BY k""",
)
def _(t):
    return pf.top_k_coverage(t.diagnoses, (1, 2, 5, 10, 25, 50, 100, 250))


@query(
    "top_code_table",
    f"""SELECT rank, CASE WHEN length(icd_code) > 3 THEN substr(icd_code, 1, 3) || '.' || substr(icd_code, 4)
        ELSE icd_code END AS code,
      coalesce(long_title, '(not in d_icd_diagnoses)') AS description, n_admissions,
      n_admissions / {_TOTAL} * 100.0::DOUBLE AS pct_of_cohort
      FROM frequency LEFT JOIN titles USING (icd_code) WHERE rank <= 50""",
)
def _(t):
    return pf.top_code_table(t.diagnoses, t.dictionary, 50)


_CODES_PER = """SELECT hadm_id, count(DISTINCT icd_code) AS n_codes FROM diagnoses
  WHERE icd_version = 10 GROUP BY hadm_id"""


@query("codes_per_admission", _CODES_PER)
def _(t):
    return pf.codes_per_admission(t.diagnoses)


@query(
    "codes_per_admission_stats",
    f"""SELECT min(n_codes) AS min, quantile_cont(n_codes, 0.25) AS p25, median(n_codes) AS median,
      avg(n_codes) AS mean, quantile_cont(n_codes, 0.75) AS p75, quantile_cont(n_codes, 0.95) AS p95,
      max(n_codes) AS max, count(*) AS n_admissions FROM ({_CODES_PER})""",
)
def _(t):
    return pf.codes_per_admission_stats(pf.codes_per_admission(t.diagnoses))


@query(
    "label_cooccurrence",
    """WITH head AS (SELECT icd_code FROM frequency WHERE rank <= 20),
      cells AS (SELECT DISTINCT hadm_id, c.icd_code FROM codes c JOIN head USING (icd_code)),
      pairs AS (SELECT x.icd_code AS a, y.icd_code AS b, count(*) AS n
        FROM cells x JOIN cells y USING (hadm_id) GROUP BY 1, 2)
      SELECT x.icd_code AS code_a, y.icd_code AS code_b, coalesce(n, 0) AS n
      FROM head x CROSS JOIN head y LEFT JOIN pairs ON a = x.icd_code AND b = y.icd_code""",
)
def _(t):
    return label_cooccurrence(t.diagnoses, 20)


def _demographics(people):
    from cohortloom.functions.numbers import AGE_EDGES, AGE_LABELS

    ages = ", ".join(
        f"({lo}, {hi}, '{name}')" for lo, hi, name in zip(AGE_EDGES, AGE_EDGES[1:], AGE_LABELS)
    )
    return f"""SELECT 'gender' AS dimension, coalesce(gender, 'nan') AS bucket, count(*) AS n,
      count(*) / (SELECT count(*) FROM {people}) * 100.0::DOUBLE AS pct FROM {people} GROUP BY gender
      UNION ALL SELECT 'age_bucket', name, count(subject_id),
      count(subject_id) / (SELECT count(*) FROM {people} WHERE anchor_age >= 0 AND anchor_age < 200) * 100.0::DOUBLE
      FROM (VALUES {ages}) AS v(lo, hi, name) LEFT JOIN {people}
      ON anchor_age >= lo AND anchor_age < hi GROUP BY name"""


@query("patient_demographics", _demographics("patients"))
def _(t):
    return pf.patient_demographics(t.patients)


@query("admissions_per_patient", "SELECT subject_id, n_admissions FROM per_patient")
def _(t):
    return pf.admissions_per_patient(t.admissions)


def _per_patient_stats(source):
    return f"""SELECT count(*) AS n_patients, min(n_admissions) AS min, median(n_admissions) AS median,
      avg(n_admissions) AS mean, quantile_cont(n_admissions, 0.95) AS p95, max(n_admissions) AS max,
      count(*) FILTER (n_admissions = 1) AS patients_with_single_admission,
      count(*) FILTER (n_admissions >= 5) AS patients_with_5plus_admissions FROM {source}"""


@query("admissions_per_patient_stats", _per_patient_stats("per_patient"))
def _(t):
    return pf.admissions_per_patient_stats(pf.admissions_per_patient(t.admissions))


@query(
    "multi_admission_share",
    """SELECT count(*) AS n_patients, count(*) FILTER (n_admissions > 1) AS n_multi,
      count(*) FILTER (n_admissions > 1) / count(*) * 100.0::DOUBLE AS pct_multi FROM per_patient""",
)
def _(t):
    return pf.multi_admission_share(pf.admissions_per_patient(t.admissions))


@query(
    "los_summary",
    """SELECT round(median(los_days), 9) AS median, round(avg(los_days), 9) AS mean,
      round(quantile_cont(los_days, 0.95), 9) AS p95 FROM stays""",
)
def _(t):
    row = pf.los_summary(t.admissions)
    return row.select(*[F.round(c, 9).alias(c) for c in ("median", "mean", "p95")])


@query(
    "mortality_rate",
    """SELECT count(*) AS n_admissions, count(*) FILTER (hospital_expire_flag = 1) AS n_deaths,
      count(*) FILTER (hospital_expire_flag = 1) / count(*) AS rate FROM admissions""",
)
def _(t):
    return pf.mortality_rate(t.admissions)


_STAT_NAMES = (
    "n_patients", "min", "median", "mean", "p95", "max",
    "patients_with_single_admission", "patients_with_5plus_admissions",
)


@query(
    "cohort_demographics",
    f"""WITH people AS (SELECT * FROM patients WHERE subject_id IN (SELECT subject_id FROM cohort_stays)),
      visits AS (SELECT subject_id, count(*) AS n_admissions FROM cohort_stays GROUP BY subject_id),
      stats AS ({_per_patient_stats("visits")})
      SELECT dimension, bucket, CAST(n AS DOUBLE) AS value, pct FROM ({_demographics("people")}) """
    + " ".join(
        f"UNION ALL SELECT 'admissions_per_patient', '{c}', CAST({c} AS DOUBLE), NULL FROM stats"
        for c in _STAT_NAMES
    ),
)
def _(t):
    return pf.cohort_demographics(t.notes, t.admissions, t.diagnoses, t.patients)


@query(
    "histogram_counts",
    f"""WITH b AS (SELECT CAST(min(n_tokens) AS DOUBLE) AS lo, CAST(max(n_tokens) AS DOUBLE) AS hi FROM lengths)
      SELECT 'tokens' AS figure, CAST(least(floor((n_tokens - lo) * 80 / (hi - lo)), 79) AS INT) AS bin,
        count(*) AS n FROM lengths, b GROUP BY 2
      UNION ALL SELECT 'codes', CAST(least(n_codes, 40) AS INT), count(*) FROM ({_CODES_PER}) GROUP BY 2
      UNION ALL SELECT 'admissions', CAST(least(n_admissions, 20) AS INT), count(*) FROM per_patient
        GROUP BY 2""",
)
def _(t):
    parts = {
        "tokens": pf.equal_width_histogram(lengths(t), "n_tokens", 80),
        "codes": pf.capped_histogram(pf.codes_per_admission(t.diagnoses), "n_codes", 40),
        "admissions": pf.capped_histogram(
            pf.admissions_per_patient(t.admissions), "n_admissions", 20
        ),
    }
    named = [df.select(F.lit(name).alias("figure"), "bin", "n") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])
