"""Connected components of a large edge table, by rounds of star contraction on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(turned)


def _nearest(pairs: DataFrame, limit) -> DataFrame:
    """For every node the smallest of itself and its neighbours, joined back to the neighbours that pass `limit`."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (pairs.join(least, "a").where(limit(F.col("a"), F.col("b")))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the smallest node that can be reached.

    Nulls, loops and repeated edges are ignored; an empty table gives no rows. Each round is two shuffles of the edges,
    whose number never grows, and rounds grow with the logarithm of the longest path. A node with very many neighbours
    is summed before the shuffle and split by Spark's skewed join.
    """
    edges = (edges.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = stored(edges, "edges")
    before = _signature(edges)
    while True:
        # large star: larger neighbours move to the smallest neighbour; small star: the others do
        large = _nearest(_both(edges), lambda a, b: b > a).distinct()
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(small.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct(), "edges")
        now = _signature(edges)
        if now == before:
            return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
                    .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
        before = now
