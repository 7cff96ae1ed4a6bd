"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only.

Both sides are cut into lower-cased words. A text keeps the smallest hash of ``K`` consecutive words in
every run of ``WINDOW - K + 1`` such hashes, so two texts that share ``WINDOW`` words in a row always
keep a common hash. Kept hashes of documents meet those of the benchmark; each hit is extended to the
word windows around it, and a window counts only if its words are exactly those of a benchmark window.
Items with fewer than ``WINDOW`` words are one window of their own length, looked up at that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import LOWER, UPPER, once, union
from cohortloom.session import cut_lineage

WINDOW = 10
K = 5
# What stands between words, in lower-cased and in any text.
NOT_WORD = r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
CASED_NOT_WORD = r"[\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"

# Bits of the place that a packed hash carries; a window is far shorter than what they count.
_PLACE_BITS = 24


def words(text: str) -> Column:
    """Words of a text; none for null."""
    given = F.coalesce(F.col(text), F.lit(""))
    # both change A to Z only; the second is slow, and needed where other letters have a lower case too
    ascii_only = F.octet_length(given) == F.length(given)
    lowered = F.when(ascii_only, F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def _grams(k: int) -> str:
    """Hashes of all ``k`` consecutive word hashes ``v``."""
    mixed = ", ".join(f"v[i + {j}]" if j else "v[i]" for j in range(k))
    return f"transform(sequence(0, size(v) - {k}), i -> xxhash64({mixed}))"


def _winnow(run: int) -> tuple[str, str]:
    """Places of the smallest hash ``h`` of each run; the leftmost of equal ones. Each place once.

    Second, the array ``m`` that this reads: a hash with the low bits of its place in one number, so that the
    least number of a run tells the place.
    """
    low = (1 << _PLACE_BITS) - 1
    packed = f"transform(h, (x, i) -> shiftleft(x, {_PLACE_BITS}) | (i & {low}))"
    smallest = "least(" + ", ".join(f"m[i + {j}]" if j else "m[i]" for j in range(run)) + ")" if run > 1 else "m[i]"
    return (
        f"array_distinct(transform(sequence(0, size(m) - {run}), i -> i + cast(({smallest} - i) & {low} AS int)))"
    ), packed


def _unfolded(df: DataFrame, columns: list[str], cells: str) -> DataFrame:
    """A row for each struct of an array. The outer form computes the array once; the plain one is preceded
    by a test for emptiness that computes it as well."""
    rows = df.select(*columns, F.inline_outer(F.expr(cells)))
    return rows.filter(F.col(next(c for c in rows.columns if c not in columns)).isNotNull())


def fingerprints(df: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Rows (key, h, first, c): kept hashes of a table (key, w) of word arrays with ``window`` words or more.

    ``c`` holds the words of all windows around the hash, of which ``first`` is the place of the first.
    """
    places, packed = _winnow(window - k + 1)
    cut = once(df.filter(F.size("w") >= window), v=F.expr("transform(w, x -> xxhash64(x))"))
    cut = once(cut.select(*df.columns, "v"), h=F.expr(_grams(k)))
    cut = once(cut.select(*df.columns, "h"), m=F.expr(packed))
    cells = (
        f"transform({places}, p -> named_struct('h', h[p], 'first', greatest(p - {window - k}, 0), "
        f"'c', slice(w, greatest(p - {window - k}, 0) + 1, least(p, {window - k}) + {window})))"
    )
    return _unfolded(cut, [c for c in df.columns if c != "w"], cells)


def _windows(df: DataFrame, size: int) -> DataFrame:
    """All windows of ``size`` words (item_id, n, win)."""
    cell = f"transform(sequence(1, size(w) - {size - 1}), i -> array_join(slice(w, i, {size}), ' '))"
    return df.select("item_id", F.lit(size).alias("n"), F.explode(F.expr(cell)).alias("win"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What rows of equal id and text share: 96 bits, never null."""
    text = F.col(text_col)
    return F.struct(
        F.xxhash64(F.col(id_col), text).alias("a"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("b")
    )


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Windows of documents (key, text) that a benchmark (item_id, text) holds.

    Returns (key, s, n, win): start, words and text of each hit window, and (item_id, n, win): the windows of
    items. A fingerprint carries the words around it, at most ``2 * window - k``, so that no text moves. All
    joins are Spark's to choose: the benchmark sides are written tables, broadcast if they are small enough.
    """
    items = cut_lineage(bench.select("item_id", words("text").alias("w")), "bench-words")
    short = [
        r[0]
        for r in items.select(F.size("w").alias("n")).filter(f"n > 0 and n < {window}").distinct().collect()
    ]  # at most window - 1 values
    sized = [_windows(items.filter(F.size("w") >= window), window)]
    sized += [_windows(items.filter(F.size("w") == n), n) for n in sorted(short)]
    owners = cut_lineage(union(sized).distinct(), "bench-windows")
    wins = cut_lineage(owners.select("n", "win").distinct(), "bench-texts")

    # (n, h): the kept hashes of windows, and the hash of each short item as a whole
    marked = [fingerprints(items, window, k).select(F.lit(window).alias("n"), "h")]
    whole = "aggregate(transform(w, x -> xxhash64(x)), 0L, (a, x) -> xxhash64(a, x))"
    marked += [
        items.filter(F.size("w") == n).select(F.lit(n).alias("n"), F.expr(whole).alias("h")) for n in sorted(short)
    ]
    marks = cut_lineage(union(marked).distinct(), "bench-marks")
    cut = once(docs.select("key", "text"), w=words("text")).select("key", "w")
    found = [fingerprints(cut, window, k).withColumn("n", F.lit(window))]
    for n in sorted(short):
        chain = "0L"
        for j in range(n):
            chain = f"xxhash64({chain}, v[i + {j}])"
        hashed = once(cut.filter(F.size("w") >= n), v=F.expr("transform(w, x -> xxhash64(x))"))
        cells = (
            f"transform(sequence(0, size(v) - {n}), i -> "
            f"named_struct('h', {chain}, 'first', i, 'c', slice(w, i + 1, {n})))"
        )
        found.append(_unfolded(hashed, ["key"], cells).withColumn("n", F.lit(n)))
    met = union(found).join(marks, ["n", "h"], "left_semi")
    around = (
        "transform(sequence(0, size(c) - n), j -> "
        "named_struct('s', first + j, 'win', array_join(slice(c, j + 1, n), ' ')))"
    )
    tried = _unfolded(met, ["key", "n"], around)
    return cut_lineage(tried.join(wins, ["n", "win"], "left_semi").distinct(), "window-hits"), owners


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    k: int = K,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Rows that repeat id and text each get their own, equal row; null ids
    are kept. Ids of documents and items keep their type; items that repeat an id are one item with the
    windows of all its texts, and a null item id counts as the item "null". An empty benchmark contaminates
    nothing. Other columns are ignored.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), keyed(docs, id_col, text_col).alias("key")
    )
    held = bench.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), F.col(text_col).alias("text")
    )
    # rows that repeat are looked at once
    hit, owners = hits(base.select("key", "text"), held, window, k)
    per_doc = hit.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("s", "n"))).alias("spans")
    )  # spans of one document
    # union of the spans by start: each adds what reaches beyond the furthest end so far
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'e', 0L), (a, x) -> named_struct("
        "'n', a.n + greatest(0L, x.s + x.n - greatest(a.e, cast(x.s as bigint))),"
        "'e', greatest(a.e, cast(x.s + x.n as bigint))), a -> a.n)"
    )
    per_doc = per_doc.select("key", covered.alias("n_hit"))
    items = (
        hit.select("key", "n", "win").distinct().join(owners, ["n", "win"]).select("key", "item_id").distinct()
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        .select(
            "key",
            F.size("ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("ids", ","), 256).alias("sha"),
        )
    )
    found = cut_lineage(per_doc.join(items, "key", "left"), "contaminated")
    # upper-case letters need no translation to be counted
    cut = F.split(F.coalesce("text", F.lit("")), CASED_NOT_WORD)
    n_words = F.size(F.array_remove(cut, "")).cast("long")
    return (
        base.select("doc_id", "key", n_words.alias("n_words"))
        .join(found, "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without any benchmark window, all columns as they are, whatever their names."""
    own = docs.select(keyed(docs, id_col, text_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    pairs = docs.select(keyed(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    held = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    hit, _ = hits(pairs, held)
    return own.join(hit.select("key").distinct(), "key", "left_anti").select("row.*")


_CUT = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same by comparing all windows, for the other engine.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_CUT} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS id, {_CUT} AS w FROM benchmark),
iw AS (SELECT DISTINCT id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
  SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (
    SELECT id, w, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
  SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT k, s, n, id FROM dw JOIN iw USING (n, win)),
words_hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
items_hit AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, id FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (k) LEFT JOIN items_hit USING (k)"""
