"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage, discard

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add dear columns so that the optimizer does not paste their expression into each use."""
    cell = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*df.columns, F.inline(F.array(cell)))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each node of undirected ``links`` (a, b); nodes without links are absent.

    Alternates large-star and small-star on tables written to the shared folder. A node of any
    degree costs one aggregate row per task and one join row per link; the number of links never grows.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour of a node moves to the node's minimum
        large = (
            both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        large = cut_lineage(large, "large-star")
        # small star: every smaller neighbour, and the node itself, moves to the minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        small = cut_lineage(small, "small-star")
        discard(edges, large)
        # done once every node hangs on one root and no root hangs on another node
        many = small.groupBy("a").count().filter("count > 1").limit(1).count()
        chained = 0 if many else small.join(
            small.select(F.col("a").alias("b")).distinct(), "b", "left_semi"
        ).limit(1).count()
        edges = small
        if not many and not chained:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
