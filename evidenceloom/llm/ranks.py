"""Places in a total order, and running sums along it, without a window over all rows.

Rows are dealt out by ranges of the order and sorted there; only the ranges' own sums, one row for each
range, are added up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_INDEX = (1 << 33) - 1


def parts_for(rows: int, each: int, spark) -> int:
    """Tasks for so many rows: the session's shuffle partitions, and more where a task would get over each rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def numbered(df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """df as a written table with _part, the range of its row, and _index, the row's place in its range. order: as sort() takes it."""
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    # both are made from one value of one plan, and written before anything reads them
    return written(dealt.withColumn("_row", row).select("*", F.shiftright("_row", 33).cast("int").alias("_part"), F.col("_row").bitwiseAND(F.lit(_INDEX)).alias("_index")).drop("_row"), name)


def before(sums: DataFrame, keys: list[str], part: str, value: str, name: str) -> DataFrame:
    """sums, a row for each (keys, part), with the sum of value over the parts before it."""
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def ranked(df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """df with rank, its place in the whole order from 0."""
    rows = numbered(df, order, parts, name)
    offsets = before(rows.groupBy("_part").agg(F.count("*").alias("_n")), [], "_part", "_n", "_before").select("_part", "_before")
    return rows.join(offsets, "_part").withColumn("rank", F.col("_before") + F.col("_index")).drop("_part", "_index", "_before")
