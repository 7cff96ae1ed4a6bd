"""Note filters, deduplication and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.errors import LabelError
from cohortloom.functions.codes import normalize_code
from cohortloom.functions.text import char_length, clean_text, clean_token_length, token_length
from cohortloom.operators.ordered import ranked
from cohortloom.operators.tables import computed_once
from cohortloom.session import cut_lineage

SILVER_COLUMNS = ("note_id", "subject_id", "hadm_id", "text", "n_tokens")


def filter_note_types(notes: DataFrame, note_types: Sequence[str] = ("DS",)) -> DataFrame:
    return notes.filter(F.col("note_type").isin(list(note_types)))


def dedup_latest_note(notes: DataFrame) -> DataFrame:
    """One note per admission: the highest sequence number, then the highest note id.

    Spark limits every group to one row before the shuffle, so an admission (or the null key) with
    a large share of all notes sends one row per task.
    """
    latest = W.partitionBy("hadm_id").orderBy(F.desc("note_seq"), F.desc("note_id"))
    return notes.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def filter_min_tokens(notes: DataFrame, min_tokens: int = 100) -> DataFrame:
    return notes.filter(F.col("n_tokens") >= min_tokens)


def build_silver_notes(
    notes: DataFrame, note_types: Sequence[str] = ("DS",), min_tokens: int = 100
) -> DataFrame:
    """Type filter, one note per admission, cleaning, length filter."""
    kept = dedup_latest_note(filter_note_types(notes, note_types))
    cleaned = computed_once(kept, text=clean_text(F.col("text")))
    counted = cleaned.withColumn("n_tokens", clean_token_length(F.col("text")))
    return filter_min_tokens(counted, min_tokens).select(*SILVER_COLUMNS)


def filter_code_version(diagnoses: DataFrame, version: int = 10) -> DataFrame:
    """Normalised codes of one version as ``(hadm_id, icd_code)``; null codes are dropped."""
    if "icd_version" not in diagnoses.columns:
        raise LabelError("diagnoses have no icd_version column")
    at_version = diagnoses.filter((F.col("icd_version") == version) & F.col("icd_code").isNotNull())
    return at_version.select("hadm_id", normalize_code(F.col("icd_code")).alias("icd_code"))


def dedup_dictionary(dictionary: DataFrame, version: int = 10) -> DataFrame:
    """One title per normalised code at a version: the alphabetically first."""
    at_version = dictionary.filter(F.col("icd_version") == version)
    codes = at_version.select(normalize_code(F.col("icd_code")).alias("icd_code"), "long_title")
    return codes.groupBy("icd_code").agg(F.min("long_title").alias("long_title"))


def sample_order(seed: int, key: str) -> Column:
    """A seeded pseudo-random order of the rows, the same on every run and engine; null is a key as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("\x00"))))


# Hash digits that rows are counted by: 16 ** 3 counts reach the driver for each group.
_PREFIX = 3


def _first_by_hash(df: DataFrame, sizes: dict[str | None, int], seed: int, key: str, by: str | None = None) -> DataFrame:
    """The rows that come first in the seeded order: of each value of ``by`` as many as ``sizes`` says.

    Rows are counted by hash prefix, which tells the prefixes that are in as a whole and the one that is
    cut. Rows of a cut prefix are ranked over ranges of the table; rows of equal keys follow in the order of
    their other columns, then of their place in the written table, so that repeated keys cannot move a size.
    """
    h = sample_order(seed, key)
    group = F.col(by) if by else F.lit(None).cast("string")
    prefix = F.substring(h, 1, _PREFIX)
    counts = df.groupBy(group.alias("g"), prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        counts = counts.filter(F.col("g").isin(list(sizes)))
    counted: dict[str | None, list[tuple[str, int]]] = {}
    for r in counts.collect():  # 4096 rows a group at most
        counted.setdefault(r.g, []).append((r.p, r.n))
    whole, parts = F.lit(False), []
    for name, n in sizes.items():
        mine = group == F.lit(name) if by else F.lit(True)
        seen, cut = 0, None
        for bucket, size in sorted(counted.get(name, [])):
            if seen + size > n:
                cut = bucket
                break
            seen += size
        below = mine if cut is None else mine & (prefix < cut)
        whole = whole | below
        if cut is not None and n > seen:
            parts.append((mine & (prefix == cut), n - seen))
    drawn = df.filter(whole)
    others = [c for c, kind in df.dtypes if "map<" not in kind]
    for edge, n in parts:
        rows = df.filter(edge).withColumn("_h", h).withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in others]))
        placed = cut_lineage(rows.withColumn("_place", F.monotonically_increasing_id()), "sample-edge")
        order = [F.col("_h"), F.col("_row"), F.col("_place")]
        first = ranked(placed, order, "_rank").filter(F.col("_rank") <= n)
        drawn = drawn.unionByName(first.select(*[F.col(f"`{c}`") for c in df.columns]))
    return drawn


def sample_fixed_n(
    df: DataFrame, n: int | None = 5000, seed: int = 0, key: str = "note_id"
) -> DataFrame:
    """``n`` rows drawn without replacement; the whole table if ``n`` is None or it has fewer.

    Exactly ``n`` rows come out, also if keys repeat or are null. One scan of the key column counts; the
    rows then find themselves by their own hash.
    """
    return df if n is None else _first_by_hash(df, {None: n}, seed, key)


def sample_split_subset(
    manifest: DataFrame, sizes: dict[str, int], seed: int = 42, key: str = "hadm_id"
) -> DataFrame:
    """A fixed number of rows of each named split, drawn without replacement; all of a smaller split."""
    return _first_by_hash(manifest, dict(sizes), seed, key, by="split")


def compute_lengths(notes: DataFrame) -> DataFrame:
    """Append character and token counts."""
    text = F.col("text")
    return notes.withColumns({"n_chars": char_length(text), "n_tokens": token_length(text)})
