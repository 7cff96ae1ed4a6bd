"""Leak-free splits: all rows of a subject fall into the same part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.errors import SplitError

SPLITS = ("train", "val", "test")

# Hash prefix that buckets the subjects for the search of the cut points: 16**3 buckets.
_PREFIX = 3


def _hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("\x00"))))


def _cut_points(subjects: DataFrame, counts: list[tuple[str, int]], ranks: list[int]) -> list[str]:
    """Hashes at the given 1-based ranks of the hash order.

    The counts per hash prefix tell which bucket holds a rank; only those buckets, about one subject
    in 4096 each, are ordered.
    """
    wanted: dict[int, tuple[str, int]] = {}
    seen = 0
    for bucket, n in counts:
        for rank in ranks:
            if seen < rank <= seen + n:
                wanted[rank] = (bucket, rank - seen)
        seen += n
    within = W.partitionBy("bucket").orderBy("h")
    placed = (
        subjects.select("h", F.substring("h", 1, _PREFIX).alias("bucket"))
        .filter(F.col("bucket").isin(sorted({b for b, _ in wanted.values()})))
        .withColumn("place", F.row_number().over(within))
        .filter(F.col("place").isin(sorted({p for _, p in wanted.values()})))
    )
    at = {(r.bucket, r.place): r.h for r in placed.collect()}
    return [at[wanted[rank]] for rank in ranks]


def patient_split(
    notes: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Manifest ``(hadm_id, subject_id, split)`` with exact numbers of subjects per part.

    Subjects are ordered by a seeded hash; the first ``round(train * n)`` train, the next
    ``round(val * n)`` validate, the rest test. Once the two cut points are known, a row finds its
    part from its own hash: no shuffle and no join of the notes. Rows without a subject might be anyone's
    and stay together, as one subject of their own.
    """
    total = train + val + test
    if abs(total - 1.0) > 1e-6:
        raise SplitError(f"fractions sum to {total}, not 1")
    subjects = notes.select("subject_id").distinct().select(_hash(seed, "subject_id").alias("h"))
    bucket = F.substring("h", 1, _PREFIX).alias("bucket")
    rows = subjects.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()  # 4096 at most
    counts = sorted((r.bucket, r.n) for r in rows)
    n = sum(size for _, size in counts)
    n_train, n_val = int(round(train * n)), int(round(val * n))
    ends = {"train": n_train, "val": min(n_train + n_val, n)}
    ranks = sorted({r for r in ends.values() if r > 0})
    hashes = dict(zip(ranks, _cut_points(subjects, counts, ranks))) if ranks else {}
    h = _hash(seed, "subject_id")
    part = F.when(F.lit(False), F.lit("test"))
    for name in ("train", "val"):
        if ends[name] > 0:
            part = part.when(h <= hashes[ends[name]], F.lit(name))
    return notes.select("hadm_id", "subject_id", part.otherwise(F.lit("test")).alias("split"))


def split_disjoint_check(manifest: DataFrame) -> DataFrame:
    """Subjects found in more than one part; empty for a sound manifest."""
    per_subject = manifest.groupBy("subject_id").agg(
        F.min("split").alias("a"), F.max("split").alias("b"), F.count(F.lit(1)).alias("n_rows")
    )
    return per_subject.filter(F.col("a") != F.col("b")).select("subject_id", "n_rows")


def require_disjoint(manifest: DataFrame) -> None:
    leaking = split_disjoint_check(manifest).limit(1).count()
    if leaking:
        raise SplitError("a subject is in more than one split")


def split_counts(manifest: DataFrame) -> DataFrame:
    """Subjects and admissions per part."""
    per_subject = manifest.groupBy("split", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    return per_subject.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_patients"), F.sum("n").alias("n_admissions")
    )


def join_split_manifest(df: DataFrame, manifest: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of one part, or all rows with the part they are in."""
    if split is None:
        return df.join(manifest.select("hadm_id", "split"), "hadm_id")
    keys = manifest.filter(F.col("split") == split).select("hadm_id")
    return df.join(keys, "hadm_id", "left_semi")


def label_coverage_report(
    vectors: DataFrame, manifest: DataFrame, labels: Sequence[str]
) -> DataFrame:
    """Share of positive rows per label and part, from the label vectors.

    The manifest is joined once per admission; its cells unfold after the join.
    """
    codes = F.array(*[F.lit(c) for c in labels])
    cells = join_split_manifest(vectors, manifest).select(
        "split", F.inline(F.arrays_zip(codes.alias("label"), F.col("y").alias("y")))
    )
    shares = [
        F.avg(F.when(F.col("split") == name, F.col("y").cast("double"))).alias(f"{name}_pct")
        for name in SPLITS
    ]
    return cells.groupBy("label").agg(*shares)
