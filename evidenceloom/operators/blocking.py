"""Candidate pairs by shared keys, each pair once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_pairs(rows: DataFrame, node: str, keys: str, most: int) -> DataFrame:
    """Pairs a < b of nodes that share a key, of keys with at most so many nodes.

    The limit is part of the operator's meaning (a key that many share says nothing). It is applied to counts
    before the self-join, so a frequent key never meets itself; what is left makes most/2 pairs a row.
    """
    exploded = rows.select(F.col(node).alias("n"), F.explode(F.array_distinct(keys)).alias("k")).where("k is not null and k != ''").distinct()
    counted = exploded.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c").between(2, most)).select("k")
    few = exploded.join(counted, "k")
    left, right = few.select("k", F.col("n").alias("a")), few.select("k", F.col("n").alias("b"))
    return left.join(right, "k").where("a < b").select("a", "b").distinct()
