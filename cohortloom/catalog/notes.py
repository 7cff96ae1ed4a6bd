"""Text, code, date and number expressions; note filters, deduplication and sampling."""

from pyspark.sql import functions as F

from cohortloom.catalog.coverage import silver_keys
from cohortloom.catalog.registry import (
    MIN_TOKENS, NOTE_TYPES, clean, norm, query, tokens,
)
from cohortloom.functions import codes as cd
from cohortloom.functions import numbers as nm
from cohortloom.functions import text as tx
from cohortloom.operators import curate as cu
from cohortloom.operators import profile as pf
from cohortloom.operators import scores as sc
from cohortloom.operators import splits as sp

@query("clean_text", f"SELECT note_id, {clean()} AS clean FROM notes")
def _(t):
    return t.texts.select("note_id", tx.clean_text(F.col("text")).alias("clean"))


@query("token_length", f"SELECT note_id, {tokens()} AS n_tokens FROM notes")
def _(t):
    return t.texts.select("note_id", tx.token_length(F.col("text")).alias("n_tokens"))


@query("char_length", "SELECT note_id, length(coalesce(text, '')) AS n_chars FROM notes")
def _(t):
    return t.texts.select("note_id", tx.char_length(F.col("text")).alias("n_chars"))


@query("compute_lengths", "SELECT note_id, n_chars, n_tokens FROM lengths")
def _(t):
    return cu.compute_lengths(t.texts).select("note_id", "n_chars", "n_tokens")


@query(
    "count_deid_markers",
    "SELECT note_id, len(regexp_extract_all(text, '_{2,}')) AS n_markers FROM notes",
)
def _(t):
    return t.texts.select("note_id", tx.count_deid_markers(F.col("text")).alias("n_markers"))


@query(
    "normalize_code",
    f"SELECT hadm_id, seq_num, {norm()} AS code FROM diagnoses",
)
def _(t):
    return t.diagnoses.select("hadm_id", "seq_num", cd.normalize_code(F.col("icd_code")).alias("code"))


@query(
    "format_code",
    f"""SELECT hadm_id, seq_num, CASE WHEN length(c) > 3 THEN substr(c, 1, 3) || '.' || substr(c, 4)
    ELSE c END AS code FROM (SELECT hadm_id, seq_num, {norm()} AS c FROM diagnoses)""",
)
def _(t):
    code = cd.normalize_code(F.col("icd_code"))
    return t.diagnoses.select("hadm_id", "seq_num", cd.format_code(code).alias("code"))


# dates as text, every third of them unreadable
_WRITTEN = "CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE {text} END"


@query(
    "parse_ts_coerce",
    "SELECT o_orderkey, try_cast("
    + _WRITTEN.format(text="strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")
    + " AS TIMESTAMP) AS ts FROM orders",
)
def _(t):
    text = F.expr(_WRITTEN.format(text="date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')"))
    return t.base("orders").select("o_orderkey", nm.parse_ts_coerce(text).alias("ts"))


@query("year_of", "SELECT hadm_id, CAST(year(admittime) AS INT) AS year FROM admissions")
def _(t):
    return t.admissions.select("hadm_id", nm.year_of(F.col("admittime")).alias("year"))


@query("length_of_stay", "SELECT hadm_id, los_days FROM stays")
def _(t):
    return pf.with_length_of_stay(t.admissions).select("hadm_id", "los_days")


@query(
    "numeric_coerce",
    """SELECT o_orderkey, coalesce(try_cast(CASE WHEN o_orderkey % 4 = 0 THEN 'n/a'
       ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE), 0) AS number FROM orders""",
)
def _(t):
    text = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END")
    return t.base("orders").select("o_orderkey", nm.numeric_coerce(text).alias("number"))


_AGES = "CASE " + " ".join(
    f"WHEN anchor_age >= {lo} AND anchor_age < {hi} THEN '{name}'"
    for lo, hi, name in [
        (0, 18, "<18"), (18, 30, "18-29"), (30, 45, "30-44"), (45, 55, "45-54"),
        (55, 65, "55-64"), (65, 75, "65-74"), (75, 85, "75-84"), (85, 200, "85+"),
    ]
) + " END"


@query("age_bucket", f"SELECT subject_id, {_AGES} AS bucket FROM patients")
def _(t):
    return t.patients.select("subject_id", nm.age_bucket(F.col("anchor_age")).alias("bucket"))


@query("clip_upper", "SELECT subject_id, least(n_admissions, 20) AS n FROM per_patient")
def _(t):
    per = pf.admissions_per_patient(t.admissions)
    return per.select("subject_id", nm.clip_upper(F.col("n_admissions"), 20).alias("n"))


@query(
    "default_description",
    """SELECT icd_code, coalesce(long_title, '(no description)') AS description
       FROM frequency LEFT JOIN titles USING (icd_code)""",
)
def _(t):
    titled = pf.join_code_titles(pf.code_counts(t.diagnoses), t.dictionary)
    return titled.select("icd_code", cd.default_description(F.col("long_title")).alias("description"))


@query(
    "real_year_approx",
    r"""SELECT a.hadm_id, admittime, year(admittime) - anchor_year
      + (CAST(regexp_extract(anchor_year_group, '(\d{4})\s*-\s*(\d{4})', 1) AS INT)
       + CAST(regexp_extract(anchor_year_group, '(\d{4})\s*-\s*(\d{4})', 2) AS INT)) / 2.0::DOUBLE AS real_year
      FROM admissions a JOIN patients p USING (subject_id)""",
)
def _(t):
    joined = t.admissions.join(t.patients, "subject_id")
    year = nm.real_year_approx(F.col("admittime"), F.col("anchor_year"), F.col("anchor_year_group"))
    return joined.select("hadm_id", "admittime", year.alias("real_year"))


@query(
    "redacted_context",
    r"""SELECT note_id, trim(regexp_replace('...' || substr(text, greatest(s - 40, 1), s - greatest(s - 40, 1))
      || '[REDACTED]' || substr(text, s + n, 40) || '...', '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS context
      FROM (SELECT note_id, text, length(regexp_extract(text, '(?s)^(.*?)_{2,}', 1)) + 1 AS s,
        length(regexp_extract(text, '_{2,}')) AS n FROM notes WHERE regexp_matches(text, '_{2,}'))""",
)
def _(t):
    text = F.col("text")
    marked = t.texts.filter(text.rlike(tx.REDACTION_MARKER))
    start = tx.match_start(text, tx.REDACTION_MARKER)
    length = F.length(F.regexp_substr(text, F.lit(tx.REDACTION_MARKER)))
    return marked.select("note_id", tx.redacted_context(text, start, length).alias("context"))


@query("threshold_predict", "SELECT hadm_id, icd_code, prob, pred FROM decided")
def _(t):
    return sc.threshold_predict(t.predictions, t.cutoffs)


@query(
    "pct_round",
    """SELECT note_type, count(*) AS n, round(100.0 * count(*) / greatest((SELECT count(*) FROM notes), 1), 3)
      AS pct FROM notes GROUP BY note_type""",
)
def _(t):
    shares = pf.note_type_distribution(t.notes, digits=3)
    return shares.select("note_type", F.col("count").alias("n"), "pct")


_TYPES = ", ".join(f"'{n}'" for n in NOTE_TYPES)


@query("filter_note_types", f"SELECT note_id, note_type FROM notes WHERE note_type IN ({_TYPES})")
def _(t):
    return cu.filter_note_types(t.notes, NOTE_TYPES).select("note_id", "note_type")


@query(
    "dedup_latest_note",
    """SELECT note_id, hadm_id, text FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id
       ORDER BY note_seq DESC, note_id DESC) AS rn FROM notes) WHERE rn = 1""",
)
def _(t):
    return cu.dedup_latest_note(t.notes).select("note_id", "hadm_id", "text")


@query(
    "filter_min_tokens",
    f"SELECT note_id, n_tokens FROM lengths WHERE n_tokens >= {MIN_TOKENS}",
)
def _(t):
    counted = cu.compute_lengths(t.texts)
    return cu.filter_min_tokens(counted, MIN_TOKENS).select("note_id", "n_tokens")


@query("build_silver_notes", "SELECT note_id, subject_id, hadm_id, text, n_tokens FROM silver")
def _(t):
    return cu.build_silver_notes(t.notes, NOTE_TYPES, MIN_TOKENS)


@query("filter_code_version", "SELECT hadm_id, icd_code FROM codes")
def _(t):
    return cu.filter_code_version(t.diagnoses)


@query("dedup_dictionary", "SELECT icd_code, long_title FROM titles")
def _(t):
    return cu.dedup_dictionary(t.dictionary)


@query(
    "sample_fixed_n",
    "SELECT note_id, hadm_id FROM notes ORDER BY md5('0:' || note_id), note_id LIMIT 300",
)
def _(t):
    return cu.sample_fixed_n(t.notes, 300, seed=0).select("note_id", "hadm_id")


@query(
    "sample_split_subset",
    """SELECT hadm_id, subject_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split
       ORDER BY md5('42:' || hadm_id), hadm_id) AS rn FROM manifest)
       WHERE (split = 'train' AND rn <= 150) OR (split = 'val' AND rn <= 20)""",
)
def _(t):
    manifest = sp.patient_split(silver_keys(t))
    return cu.sample_split_subset(manifest, {"train": 150, "val": 20})
