"""What changed between two versions of a table, as a log of inserts, updates and deletes that streams can follow.

Rows are compared by key and two 64-bit hashes of all they hold, so the older version gives keys and hashes to the join and not its rows.
Replaying the log from its beginning, the newest change of each key, gives the newest version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenceloom.sources.tables import Versioned

_SECOND = 7046029254386353131


def _hashes(df: DataFrame, keys: list[str]) -> list[Column]:
    """Nulls and empty values differ in JSON, and so do the names that values stand under."""
    said = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns) if c not in keys)), {"ignoreNullFields": "false"})
    return [F.xxhash64(said).alias("_a"), F.xxhash64(F.lit(_SECOND), said).alias("_b")]


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """op (insert, update, delete) and after's columns; of deleted rows the key alone. Keys may hold nulls; each is one row's in either version."""
    old = before.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), *(c.alias(f"_old{n}") for n, c in zip("ab", _hashes(before, keys), strict=True)), F.lit(True).alias("_was"))
    new = after.withColumns({"_a": _hashes(after, keys)[0], "_b": _hashes(after, keys)[1], "_is": F.lit(True)})
    same = reduce(lambda x, y: x & y, (F.col(f"_k{i}").eqNullSafe(F.col(f"`{k}`")) for i, k in enumerate(keys)))
    both = old.join(new, same, "full")
    op = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when((F.col("_olda") != F.col("_a")) | (F.col("_oldb") != F.col("_b")), "update")
    columns = [F.when(F.col("_is").isNull(), F.col(f"_k{keys.index(c)}")).otherwise(F.col(f"`{c}`")).alias(c) if c in keys else F.col(f"`{c}`") for c in after.columns]
    return both.select(op.alias("op"), *columns).where("op is not null")


def publish(table: Versioned, number: int, log_path: str, keys: list[str]) -> None:
    """Writes the changes that a committed version brought. Whoever committed it does so; if he is lost, anyone may, as the outcome is the same. A version that is there whole stays."""
    path = f"{log_path}/version={number}"
    if table.exists(f"{path}/_SUCCESS"):
        return
    after = table.read(number)
    before = table.read(number - 1) if number > 1 else after.limit(0)
    diff(before, after, keys).write.mode("overwrite").parquet(path)


def follow(spark: SparkSession, log_path: str, schema: T.StructType, versions_per_batch: int | None = None) -> DataFrame:
    """The log as a stream; schema: of the table."""
    whole = T.StructType([T.StructField("op", T.StringType()), *schema, T.StructField("version", T.IntegerType())])
    reader = spark.readStream.schema(whole)
    if versions_per_batch:
        reader = reader.option("maxFilesPerTrigger", versions_per_batch)
    return reader.parquet(log_path)


def changes(spark: SparkSession, log_path: str, schema: T.StructType, after: int = 0) -> DataFrame:
    """The log as it is, from versions later than one that a reader knows; only their folders are read."""
    whole = T.StructType([T.StructField("op", T.StringType()), *schema, T.StructField("version", T.IntegerType())])
    return spark.read.schema(whole).parquet(log_path).where(F.col("version") > after)


def replay(log: DataFrame, keys: list[str]) -> DataFrame:
    """The table that the log tells of: each key's newest change, unless it is gone."""
    columns = [c for c in log.columns if c not in ("op", "version")]
    newest = F.max_by(F.struct("op", *(F.col(f"`{c}`") for c in columns)), "version").alias("_r")
    return log.groupBy(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys))).agg(newest).select("_r.*").where("op != 'delete'").drop("op")
