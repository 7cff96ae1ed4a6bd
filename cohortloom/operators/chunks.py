"""Sliding token windows over long documents, and their reduction back to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import squeeze_space
from cohortloom.operators.tables import computed_once


def chunk_tokens(
    notes: DataFrame, window: int = 512, stride: int = 128, key: str = "hadm_id", text: str = "text"
) -> DataFrame:
    """Windows of at most ``window`` tokens that overlap by ``stride``, numbered per document.

    Token arrays stay within the row; a document without tokens has no chunk.
    """
    if not 0 <= stride < window:
        raise ValueError("stride must be at least 0 and less than the window")
    step = window - stride
    squeezed = computed_once(notes.select(key, text), **{text: squeeze_space(F.col(text))})
    squeezed = squeezed.filter(F.col(text) != "")
    tokens = squeezed.select(key, F.split(text, " ").alias("_tokens"))
    last = F.greatest(F.ceil((F.size("_tokens") - window) / F.lit(float(step))), F.lit(0))
    # the windows are cut inside the row: unfolding starts first would copy all tokens per window
    windows = F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.slice(F.col("_tokens"), i * step + 1, F.lit(window)),
    )
    return tokens.select(key, F.posexplode_outer(windows).alias("chunk_idx", "tokens"))


def chunk_stats(chunks: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Documents, chunks and chunks per document; ``n_docs`` is the one-row document count."""
    counted = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    docs = n_docs.scalar()
    both = counted.select(docs.alias("n_docs"), "n_chunks")
    per_doc = F.col("n_chunks") / F.greatest("n_docs", F.lit(1))
    return both.withColumn("avg_chunks_per_doc", per_doc)


def chunk_labels(chunks: DataFrame, label_vectors: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Each chunk with the label vector of its document."""
    return chunks.join(label_vectors, key)


def maxpool_chunks(
    chunk_scores: DataFrame, documents: DataFrame, labels: DataFrame, key: str = "hadm_id"
) -> DataFrame:
    """Highest chunk probability per document and label; 0 where a document has no chunk.

    ``chunk_scores`` has one row per chunk and label. The documents get their labels from one array,
    and are joined once.
    """
    from cohortloom.operators.labels import label_list

    names = label_list(labels)
    pooled = chunk_scores.groupBy(key, "icd_code").agg(F.max("prob").alias("prob"))
    packed = pooled.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("icd_code", "prob"))).alias("_best"))
    joined = documents.select(key).join(packed, key, "left")
    codes = F.explode(F.array(*[F.lit(c) for c in names]))
    cells = joined.select(key, "_best", codes.alias("icd_code"))
    best = F.try_element_at(F.col("_best"), F.col("icd_code"))
    return cells.select(key, "icd_code", F.coalesce(best, F.lit(0.0)).alias("prob"))
