"""Ordinal cumulative-link regression on graded ratings over hashed words.

P(grade > j) = sigmoid(w.x - t_j) with one weight vector and ordered thresholds. x marks which hashed
words a whole text holds. Grades: 0 toxic, 1 poor, 2 good. The fit uses at most ``FIT_ROWS`` labelled
documents, those with the smallest hash of their id; every document is scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import texts

FIT_ROWS = 8_000  # labelled documents used for the fit at most
BUCKETS = 1 << 18
GRADES = 3
MIN_DOCS = 5  # buckets in fewer fitted documents get no weight
MIN_Z = 4.0  # nor do those whose share differs between grades by fewer standard errors

_tokens = re.compile(r"[^\W_]+|[^\w\s]+").findall


def buckets(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words and mark runs, case folded; none for null."""
    if not text:
        return np.zeros(0, np.int32)
    tokens = set(_tokens(text.lower()))
    found = {zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens}
    return np.fromiter(found, np.int32, len(found))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1 of them

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) per row and threshold."""
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def _telling(cols: np.ndarray, rows: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Which buckets differ in share below and above some threshold; the others only add noise."""
    all_docs = np.bincount(cols, minlength=BUCKETS)
    share, most = all_docs / len(grades), np.zeros(BUCKETS)
    for j in range(GRADES - 1):
        low = grades <= j
        n_low = max(int(low.sum()), 1)
        have = np.bincount(cols[low[rows]], minlength=BUCKETS)
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * n_low * (1 - n_low / (len(grades) + 1)))
        most = np.maximum(most, np.abs(have - n_low * share) / spread)
    return (all_docs >= MIN_DOCS) & (most >= MIN_Z)


def fit_arrays(
    sets: list[np.ndarray], grades: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 2e-3
) -> OrdinalModel:
    """Maximum likelihood with a quadratic penalty by Adam; thresholds stay ordered by their gaps.

    Without any fitted row all weights are 0 and the grades come out as equally likely.
    """
    weights = np.zeros(BUCKETS)
    thresholds = np.log(np.arange(1, GRADES) / (GRADES - np.arange(1, GRADES)))
    if not len(sets):
        return OrdinalModel(weights, thresholds)
    sizes = np.array([len(s) for s in sets])
    cols = np.concatenate(sets).astype(np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    used = np.flatnonzero(_telling(cols, rows, grades))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[cols] >= 0
    cols, rows = place[cols[keep]], rows[keep]
    n, m = len(sets), len(used)
    theta = np.zeros(m + GRADES - 1)
    theta[m] = thresholds[0]
    theta[m + 1 :] = np.log(np.maximum(np.diff(thresholds), 1e-3))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights=theta[cols], minlength=n)
        gaps = np.exp(theta[m + 1 :])
        cuts = theta[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        # cumulative F_j = P(grade <= j), with F_-1 = 0 and F_last = 1
        cum = 1.0 / (1.0 + np.exp(np.clip(score[:, None] - cuts[None, :], -40, 40)))
        full = np.hstack([np.zeros((n, 1)), cum, np.ones((n, 1))])
        at = np.arange(n)
        prob = np.maximum(full[at, grades + 1] - full[at, grades], 1e-12)
        dens = np.hstack([np.zeros((n, 1)), cum * (1 - cum), np.zeros((n, 1))])
        d_score = (dens[at, grades + 1] - dens[at, grades]) / prob / n  # of the negative log likelihood
        d_cuts = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            d_cuts[j] = (
                -(dens[grades == j, j + 1] / prob[grades == j]).sum()
                + (dens[grades == j + 1, j + 1] / prob[grades == j + 1]).sum()
            ) / n
        grad = np.zeros_like(theta)
        grad[:m] = np.bincount(cols, weights=d_score[rows], minlength=m) + l2 * theta[:m] / 10
        grad[m] = d_cuts.sum()
        for j in range(GRADES - 2):
            grad[m + 1 + j] = d_cuts[j + 1 :].sum() * gaps[j]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights[used] = theta[:m]
    return OrdinalModel(weights, theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))]))


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """0 toxic, 1 poor, 2 good; null without both ratings."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(
        (F.col(quality) == 1) & (F.col(toxic) == 0), 2
    )


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on a bounded sample of the labelled documents. Rows with a null rating or text are left out."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of().alias("grade"))
    rated = rated.filter("grade is not null and doc_id is not null").dropDuplicates(["doc_id"])
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    @F.pandas_udf("array<int>")
    def sets(text: pd.Series) -> pd.Series:
        return text.map(buckets)

    joined = texts(docs).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    # the sample is bounded in rows here and in buckets per row by BUCKETS
    data = joined.select("doc_id", "grade", sets("text").alias("s")).orderBy("doc_id").toArrow()
    values = data.column("s").to_pylist()
    grades = np.array(data.column("grade").to_pylist(), np.int64)
    return fit_arrays([np.array(v, np.int64) for v in values], grades)


def graded(docs: DataFrame, model: OrdinalModel, text_col: str = "text", name: str = "rating") -> DataFrame:
    """Add a struct (expected_grade, p_not_toxic, p_good) to every row; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.thresholds)
    )  # BUCKETS floats

    @F.pandas_udf("expected_grade double, p_not_toxic double, p_good double")
    def rate(text: pd.Series) -> pd.DataFrame:
        weights, thresholds = shared.value
        score = np.array([float(weights[buckets(t)].sum()) for t in text], np.float64)
        tails = OrdinalModel(weights, thresholds).tails(score.reshape(-1))
        return pd.DataFrame(
            {"expected_grade": tails.sum(axis=1), "p_not_toxic": tails[:, 0], "p_good": tails[:, 1]}
        )

    return docs.select("*", rate(F.col(text_col)).alias(name))


def ratings(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_not_toxic, p_good, keep (P(good) >= ``least``)."""
    out = graded(texts(docs), fit(docs, labels, fit_rows))
    return out.select("doc_id", "rating.*", (F.col("rating.p_good") >= least).alias("keep"))


def select_good(
    docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """Documents whose tail probability of the top grade reaches ``least``; columns as they came."""
    out = graded(docs, fit(docs, labels, fit_rows), name="__rating")
    return out.filter(F.col("__rating.p_good") >= least).drop("__rating")
