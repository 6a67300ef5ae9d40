"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenceloom.sources.scratch import removed, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes that the links (a, b) name.

    A round hangs each node's larger neighbours, then its smaller ones, on the smallest node around it; the
    number of links never grows and distances halve. Rounds end when no link changes. Each is
    a written table: lineage stays short and a lost executor costs one round. Nodes may be of any type
    that has an order, also structs, so that a label can carry what the caller wants to know of its node.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    for _ in range(rounds if state[0] else 0):
        last, now = now, written(_small(_large(now)), "links")
        before, state = state, _state(now)
        removed(last)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components not found in {rounds} rounds")
    # now each node but the smallest hangs on the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the links: the same only if no link changed."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()
