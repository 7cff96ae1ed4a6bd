"""Top-K multi-label targets as long tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.errors import LabelError, StageError
from cohortloom.functions.numbers import safe_ratio
from cohortloom.operators.coverage import restrict_codes_to_cohort
from cohortloom.operators.curate import filter_code_version
from cohortloom.operators.profile import top_frequency
from cohortloom.operators.tables import distinct_keys, top
from cohortloom.session import small_side

MAX_LABELS = 1000

# Labels whose bits share one number when pairs are counted.
TILE = 16


@dataclass(frozen=True)
class LabelSet:
    """The parts of a multi-label target.

    ``labels`` is the ordered list ``(label_idx, icd_code)``; ``cells`` the positive cells
    ``(hadm_id, label_idx, icd_code)``, none twice.
    """

    labels: DataFrame
    cells: DataFrame


def top_k_codes(codes: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent codes by rows (ties by code), indexed in alphabetical order."""
    if not 1 <= k <= MAX_LABELS:
        raise LabelError(f"k must be in 1..{MAX_LABELS}")
    counts = codes.groupBy("icd_code").agg(F.count(F.lit(1)).alias("n"))
    chosen = small_side(top(counts, [F.desc("n"), F.col("icd_code")], k).select("icd_code"))
    found = chosen.count()
    if found < k:
        raise LabelError(f"only {found} distinct codes, {k} wanted")
    order = W.partitionBy(F.lit(0)).orderBy("icd_code")
    return chosen.select((F.row_number().over(order) - 1).alias("label_idx"), "icd_code")  # k rows


def restrict_to_labels(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """Code rows whose code is a label."""
    return codes.join(small_side(labels.select("icd_code")), "icd_code", "left_semi").select(
        *codes.columns
    )


def label_cells(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """Positive cells: repeated codes of an admission count once."""
    known = codes.filter("hadm_id IS NOT NULL").join(small_side(labels), "icd_code")
    return known.select("hadm_id", "label_idx", "icd_code").distinct()


def label_sets(cohort: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per admission of the cohort with the indices of its labels, possibly none."""
    grouped = cells.groupBy("hadm_id").agg(F.array_sort(F.collect_set("label_idx")).alias("on"))
    joined = cohort.select("hadm_id").join(grouped, "hadm_id", "left")
    empty = F.array().cast("array<int>")
    return joined.select("hadm_id", F.coalesce("on", empty).alias("label_indices"))


def label_list(labels: DataFrame) -> list[str]:
    """The label codes in order; at most MAX_LABELS of them."""
    rows = labels.orderBy("label_idx").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise LabelError(f"more than {MAX_LABELS} labels")
    return [row.icd_code for row in rows]


def _dense(indices: Column, size: int) -> Column:
    """0/1 array of a set of indices."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(indices, i).cast("int")
    )


def label_vectors(cohort: DataFrame, cells: DataFrame, n_labels: int) -> DataFrame:
    """One 0/1 array over all labels per admission."""
    sets = label_sets(cohort, cells)
    return sets.select("hadm_id", _dense(F.col("label_indices"), n_labels).alias("y"))


def build_label_matrix(cohort: DataFrame, cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Every admission with every label and a 0/1 flag.

    One join per admission; its cells are unfolded from the label list afterwards.
    """
    names = label_list(labels)
    codes = F.array(*[F.lit(c) for c in names])
    vectors = label_vectors(cohort, cells, len(names))
    pairs = F.arrays_zip(codes.alias("icd_code"), F.col("y").alias("present"))
    return vectors.select("hadm_id", F.inline(pairs).alias("icd_code", "present"))


def build_labels(
    cohort: DataFrame, diagnoses: DataFrame, k: int, version: int = 10, gate: float = 0.5
) -> LabelSet:
    """Labels from the codes of the cohort alone; fails if too many admissions have none."""
    codes = restrict_codes_to_cohort(filter_code_version(diagnoses, version), cohort)
    labels = small_side(top_k_codes(codes, k))
    cells = label_cells(codes, labels)
    counted = label_totals(cohort, cells, k).first()
    if counted.n_zero_label > gate * counted.n_admissions:
        raise LabelError(
            f"{counted.n_zero_label} of {counted.n_admissions} admissions have none of the top {k} codes"
        )
    return LabelSet(labels, cells)


def label_totals(cohort: DataFrame, cells: DataFrame, n_labels: int) -> DataFrame:
    """Admissions, positive cells, density and admissions without a label, in one pass."""
    per_admission = cells.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n_on"))
    joined = cohort.select("hadm_id").join(per_admission, "hadm_id", "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("n_admissions"),
        F.coalesce(F.sum("n_on"), F.lit(0)).alias("n_positive"),
        F.count_if(F.col("n_on").isNull()).alias("n_zero_label"),
    )
    density = safe_ratio(F.col("n_positive"), F.col("n_admissions") * n_labels)
    return counted.withColumn("density", density)


def label_density(cohort: DataFrame, cells: DataFrame, n_labels: int) -> DataFrame:
    """Share of positive cells among all cells."""
    totals = label_totals(cohort, cells, n_labels)
    return totals.select("n_admissions", "n_positive", "density")


def zero_label_count(cohort: DataFrame, cells: DataFrame) -> DataFrame:
    """Admissions of the cohort without any label."""
    bare = cohort.join(distinct_keys(cells, "hadm_id"), "hadm_id", "left_anti")
    return bare.agg(F.count(F.lit(1)).alias("n_zero_label"))


def alignment(cohort: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Admissions that only one of two tables has, counted per side."""
    left = distinct_keys(cohort, "hadm_id").withColumn("in_notes", F.lit(1))
    right = distinct_keys(label_rows, "hadm_id").withColumn("in_labels", F.lit(1))
    both = left.join(right, "hadm_id", "full_outer")
    return both.agg(
        F.count_if(F.col("in_labels").isNull()).alias("notes_without_labels"),
        F.count_if(F.col("in_notes").isNull()).alias("labels_without_notes"),
    )


def check_alignment(cohort: DataFrame, label_rows: DataFrame, dense: bool = True) -> None:
    """Fail unless both tables cover the same admissions.

    Positive cells alone (``dense=False``) may lack admissions without any label, but not have others.
    """
    off = alignment(cohort, label_rows).first()
    if off.labels_without_notes or (dense and off.notes_without_labels):
        raise StageError(
            f"{off.notes_without_labels} notes without labels, {off.labels_without_notes} labels "
            "without notes: rebuild the gold stage"
        )


def label_cooccurrence(
    diagnoses: DataFrame, top_k: int = 20, version: int = 10, counts: DataFrame | None = None
) -> DataFrame:
    """Admissions with both of two top codes, for all pairs in long form; zeros included.

    The labels of an admission become a few numbers of TILE bits, merged before the one shuffle of keys;
    no pair of rows is ever formed, and pair counts are merged before they move.
    """
    order = W.partitionBy(F.lit(0)).orderBy("icd_code")
    first = top_frequency(diagnoses, top_k, version, counts).select("icd_code")  # top_k rows
    labels = small_side(first.select((F.row_number().over(order) - 1).alias("label_idx"), "icd_code"))
    names = label_list(labels)
    if not names:
        return labels.select(
            F.col("icd_code").alias("code_a"), F.col("icd_code").alias("code_b"),
            F.lit(0).cast("bigint").alias("n"),
        )
    codes = filter_code_version(diagnoses, version).filter("hadm_id IS NOT NULL")
    on = codes.join(small_side(labels), "icd_code").groupBy("hadm_id").agg(
        *[F.bit_or(_tile_bit(F.col("label_idx"), t)).alias(f"t{t}") for t in range(_tiles(len(names)))]
    )
    tiles = F.array(*[F.col(c) for c in on.columns[1:]])
    return pair_counts(on, tiles, tiles, names).select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "n")


def _tiles(n_labels: int) -> int:
    return max(1, -(-n_labels // TILE))


def _tile_bit(index: Column, tile: int | Column) -> Column:
    """The bit of a label in a tile; 0 in all other tiles."""
    inside = F.floor(index / TILE) == tile
    return F.when(inside, F.call_function("shiftleft", F.lit(1), F.pmod(index, F.lit(TILE)))).otherwise(0)


def index_tiles(indices: Column, n_labels: int) -> Column:
    """A set of label indices as one number of TILE bits per tile; other numbers and nulls do not count."""
    known = F.filter(F.coalesce(indices, F.array().cast("array<int>")), lambda i: i.between(0, n_labels - 1))
    tiles = F.sequence(F.lit(0), F.lit(_tiles(n_labels) - 1))
    return F.transform(
        tiles, lambda t: F.aggregate(known, F.lit(0), lambda bits, i: bits.bitwiseOR(_tile_bit(i, t)))
    )


def pair_counts(rows: DataFrame, on_a: Column, on_b: Column, names: list[str]) -> DataFrame:
    """Rows with label ``a`` in one set and ``b`` in another (both as ``index_tiles``), as ``(a, b, n)``.

    A label of ``a`` goes on with each tile of ``b`` that is not empty, and the bits of a tile are added up
    as plain sums. Pairs whose ``a`` occurs in some row are listed, whatever their count.
    """
    sets = rows.select(on_a.alias("on_a"), on_b.alias("on_b"))
    every = F.sequence(F.lit(0), F.lit(max(len(names), 1) - 1))
    held = F.filter(
        every, lambda i: F.get("on_a", F.floor(i / TILE).cast("int")).bitwiseAND(_tile_bit(i, F.floor(i / TILE))) != 0
    )
    tiles = F.transform("on_b", lambda bits, t: F.struct(t.alias("tile"), bits.alias("bits")))
    listed = F.struct(F.lit(-1).alias("tile"), F.lit(0).alias("bits"))  # the label itself, whatever it meets
    met = F.concat(F.array(listed), F.filter(tiles, lambda t: t["bits"] != 0))
    unfolded = sets.select(F.explode(held).alias("a"), met.alias("met")).select("a", F.inline("met"))
    bit = [F.sum(F.shiftright("bits", i).bitwiseAND(1)).alias(f"s{i}") for i in range(TILE)]
    sums = unfolded.groupBy("a", "tile").agg(*bit)
    zero = F.transform(every, lambda j: F.struct(j.alias("j"), F.lit(0).cast("bigint").alias("n")))
    counted = F.array(
        *[F.struct((F.col("tile") * TILE + i).alias("j"), F.col(f"s{i}").alias("n")) for i in range(TILE)]
    )
    cells = sums.select("a", F.inline(F.when(F.col("tile") < 0, zero).otherwise(counted)))
    cells = cells.filter(F.col("j") < len(names)).groupBy("a", "j").agg(F.sum("n").alias("n"))
    codes = F.array(*[F.lit(c) for c in names]).cast("array<string>")
    return cells.select(F.get(codes, F.col("a")).alias("a"), F.get(codes, F.col("j")).alias("b"), "n")


def label_grid(pairs: DataFrame, names: list[str], row: str, column: str, value: str) -> DataFrame:
    """Pair rows as a square table with one column per label."""
    return pairs.groupBy(row).pivot(column, names).agg(F.first(value))
