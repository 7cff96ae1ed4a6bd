"""Largest inner products by a hierarchical small-world graph per shard.

Distinct vectors are dealt to shards by hash. A shard's graph is flat neighbour arrays, one per level;
vectors get one more component so that the nearest by distance is the largest inner product. All stated
queries visit each shard in blocks, start at the top level and search the lowest with a beam; the best of
all shards are merged. Scores are recomputed in double precision from the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

SHARD_ROWS = 4096  # distinct vectors in a shard, about
DEGREE = 24
BEAM = 96
LEVEL_SHARE = 16  # one of so many nodes is on the next level


def _neighbours(v: np.ndarray, degree: int, block: int = 512) -> np.ndarray:
    """Flat (n, 2 * degree) neighbour table; -1 where there is none. Near nodes that lie closer to a
    chosen neighbour than to the node give way to others, and links are made both ways."""
    n = len(v)
    near = min(3 * degree, n - 1)
    out = np.full((n, 2 * degree), -1, np.int32)
    if near < 1:
        return out
    norms = (v * v).sum(1)
    count = np.zeros(n, np.int64)
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, n, block):
        own = v[a : a + block]
        d = norms[None, :] - 2 * own @ v.T
        d[np.arange(len(own)), np.arange(a, a + len(own))] = np.inf
        ids = np.argpartition(d, near - 1, axis=1)[:, :near]
        rank = np.argsort(np.take_along_axis(d, ids, 1), axis=1)
        ids = np.take_along_axis(ids, rank, 1)
        dist = np.take_along_axis(d, ids, 1) + norms[a : a + len(own), None]
        cand = v[ids]
        gram = np.einsum("qid,qjd->qij", cand, cand)
        inner = norms[ids][:, :, None] + norms[ids][:, None, :] - 2 * gram
        chosen = np.zeros(ids.shape, bool)
        for j in range(near):
            hidden = (chosen & (inner[:, :, j] < dist[:, j : j + 1])).any(1)
            chosen[:, j] = ~hidden & (chosen.sum(1) < degree)
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :degree]  # then the nearest of the rest
        picked = np.take_along_axis(ids, order, 1)
        out[a : a + len(own), : picked.shape[1]] = picked
        count[a : a + len(own)] = picked.shape[1]
        back.append((np.repeat(np.arange(a, a + len(own)), picked.shape[1]), picked.reshape(-1)))
    for sources, targets in back:
        for s, t in zip(sources.tolist(), targets.tolist()):
            if count[t] < 2 * degree and not (out[t, : count[t]] == s).any():
                out[t, count[t]] = s
                count[t] += 1
    return out


class Graph:
    """Levels of flat neighbour arrays over one shard's vectors."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, seed: int = 1) -> None:
        norms = (vectors**2).sum(1)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.v = np.hstack([vectors, lift[:, None]]).astype(np.float32)
        order = np.random.default_rng(seed).permutation(len(vectors))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(vectors)
        while True:
            nodes = np.sort(order[:size])
            self.levels.append((nodes, _neighbours(self.v[nodes], degree)))
            if size <= LEVEL_SHARE:
                break
            size = max(1, size // LEVEL_SHARE)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) of the best found per query, best first, -1 where there are fewer."""
        q = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        starts = np.zeros((len(q), 1), np.int64) + self.levels[-1][0][0]
        for depth in range(len(self.levels) - 1, -1, -1):
            nodes, links = self.levels[depth]
            width = min(beam if depth == 0 else 8, len(nodes))
            found, score = self._beam(q, np.searchsorted(nodes, starts), nodes, links, width)
            starts = np.where(found >= 0, nodes[found], nodes[found[:, :1]])
        return np.where(found >= 0, starts, -1), score

    def _beam(self, q, starts, nodes, links, width):
        n = len(q)
        at = np.arange(n)[:, None]
        seen = np.zeros((n, len(nodes) + 1), bool)  # the last column stands for no node
        ids = np.full((n, width), -1, np.int64)
        first = starts[:, :width]
        dup = np.zeros(first.shape, bool)
        for j in range(1, first.shape[1]):
            dup[:, j] = (first[:, :j] == first[:, j : j + 1]).any(1)
        ids[:, : first.shape[1]] = np.where(dup, -1, first)
        seen[at, ids] = True
        score = np.where(ids >= 0, np.einsum("nd,nkd->nk", q, self.v[nodes[ids]]), -np.inf)
        opened = np.zeros(ids.shape, bool)
        while True:
            open_score = np.where(opened | (ids < 0), -np.inf, score)
            best = np.argsort(-open_score, axis=1, kind="stable")[:, :4]
            live = np.take_along_axis(open_score, best, 1) > -np.inf
            if not live.any():
                break
            opened[at, best] |= live
            base = np.where(live, np.take_along_axis(ids, best, 1), -1)
            new = np.where(base[:, :, None] >= 0, links[base], -1).reshape(n, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[at, new], -1, new)
            seen[at, new] = True
            seen[:, -1] = False
            gained = np.where(new >= 0, np.einsum("nd,nkd->nk", q, self.v[nodes[new]]), -np.inf)
            ids, score = np.hstack([ids, new]), np.hstack([score, gained])
            opened = np.hstack([opened, np.zeros(new.shape, bool)])
            top = np.argsort(-score, axis=1, kind="stable")[:, :width]
            ids, score, opened = (np.take_along_axis(x, top, 1) for x in (ids, score, opened))
        return ids, score


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): k nearest of each query, the ids divisible by ``every``.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do null ids.
    Ids are distinct by contract; equal vectors may be many, and of those only the k + 1 smallest ids
    can be among the k nearest. Vectors are taken to be of one width. Fewer candidates give fewer rows.
    """
    v = F.col("v")
    usable = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    usable = cut_lineage(usable.withColumn("key", F.sha2(F.to_json("v"), 256)), "vectors")
    place = Window.partitionBy("key").orderBy("vec_id")
    ranked = usable.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k + 1)
    ranked = cut_lineage(ranked, "vectors-ranked")
    heads = ranked.filter("r = 1").select("key", "v")
    shards = max(1, -(-heads.count() // shard_rows))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    asked = usable.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.col("vec_id").alias("query_id"),
        "v",
    )
    held = heads.select(shard.alias("shard"), "key", "v")

    def find(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "key": [], "score": []})
        index = index.sort_values("key")
        own = np.array(index["v"].tolist(), np.float64)
        keys, graph, parts = index["key"].to_numpy(), Graph(own), []
        block = max(1, 50_000_000 // (len(own) + beam * 64))
        for a in range(0, len(queries), block):
            ids = queries["query_id"].to_numpy()[a : a + block]
            asked_v = np.array(queries["v"].tolist()[a : a + block], np.float64)
            for c in range(0, len(ids), 256):
                nodes, _ = graph.search(asked_v[c : c + 256], max(beam, 2 * k))
                rows, cols = np.nonzero(nodes >= 0)
                hit = nodes[rows, cols]
                score = (asked_v[c : c + 256][rows] * own[hit]).sum(1)
                frame = pd.DataFrame({"query_id": ids[c : c + 256][rows], "key": keys[hit], "score": score})
                frame = frame.sort_values(["query_id", "score"], ascending=[True, False])
                cut = frame.groupby("query_id")["score"].transform(lambda s: s.iloc[min(k, len(s) - 1)])
                parts.append(frame[frame["score"] >= cut])
        return pd.concat(parts)

    found = held.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        find, "query_id long, key string, score double"
    )
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("r", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    near = near.filter(F.col("r") <= k + 1).drop("r")
    return (
        near.join(ranked.select("key", "vec_id"), "key")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(top))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
