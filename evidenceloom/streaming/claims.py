"""The append-only claim log as a stream: late claims only change what they touch.

Canonical confidence is a function of each key's claims, so a micro-batch recomputes the keys it touches from all
their claims. Running averages and first sightings are kept as state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenceloom.operators.evidence import noisy_or


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def log_claims(stream: DataFrame, path: str, checkpoint: str):
    """The stream appended to a log, exactly once, until what is there is consumed."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute_touched(stream: DataFrame, log_path: str, key: str, fuse: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, buckets: int = 64):
    """For each micro-batch: append it, then fuse all claims of the keys it touched, and write them as that batch's version of these keys.

    The log is partitioned by a bucket of the key, so a batch reads the buckets it touches and not the whole log.
    A batch that runs again writes its own folders again, so a restart adds nothing twice.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={batch_id}")
        log = spark.read.schema(T.StructType([*batch.schema, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])).option("basePath", log_path).parquet(log_path)
        own = log.where(F.col("batch") == batch_id)
        touched = own.select(key).distinct()
        numbers = [r[0] for r in own.select("bucket").distinct().collect()]  # as many as there are buckets at most
        seen = log.where((F.col("batch") <= batch_id) & F.col("bucket").isin(numbers)).drop("batch", "bucket")
        fuse(seen.join(touched, key, "left_semi")).withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(spark: SparkSession, out_path: str, key: str, after: int = -1) -> DataFrame:
    """What changed since a version: each key's rows of later versions, oldest first; reading goes on from the last version seen."""
    rows = spark.read.option("basePath", out_path).parquet(out_path).where(F.col("batch") > after).drop("batch")
    return rows.orderBy("version", key)


def compact(spark: SparkSession, out_path: str, key: str, to: str) -> None:
    """The newest version of each key as a table of its own, after which older versions may go."""
    latest(spark, out_path, key).write.mode("overwrite").parquet(to)


def latest(spark: SparkSession, out_path: str, key: str) -> DataFrame:
    """Each key's newest version; rows are dealt once, and older ones that a task can tell go before."""
    rows = spark.read.option("basePath", out_path).parquet(out_path).drop("batch").where(F.col(key).isNotNull())
    return rows.withColumn("_n", F.rank().over(Window.partitionBy(key).orderBy(F.col("version").desc()))).where("_n = 1").drop("version", "_n")


def confidence(claims: DataFrame) -> DataFrame:
    return noisy_or(claims, ["event_id"], "source_id", F.col("trust") * F.col("confidence"))


def windowed_counts(stream: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window (sliding if there is a slide), for rows up to so late."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(window, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def session_counts(stream: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each key's sessions: runs of rows no gap apart, with their begin, end and number of rows."""
    grouped = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def finished(aggregated: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """An aggregated stream run until what is there is consumed: its whole result, each batch in place of the one before."""

    def run(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    aggregated.writeStream.outputMode("complete").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return aggregated.sparkSession.read.schema(aggregated.schema).parquet(path)


def first_seen(stream: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def running_average(stream: DataFrame, key: str, value: str, order: str, alpha: float) -> DataFrame:
    """Each key's exponential average after every batch, kept as state; rows of a batch in order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, frames, state: GroupState):
        average, n = state.get if state.exists else (0.0, 0)
        x = pd.concat(list(frames)).sort_values(order)[value].to_numpy(dtype=float)
        keep = (1 - alpha) ** np.arange(len(x) - 1, -1, -1)  # what is left of each row's weight after the later ones
        average, n = float((1 - alpha) ** len(x) * average + alpha * (keep * x).sum()), n + len(x)
        state.update((average, n))
        yield pd.DataFrame({key: [k[0]], "average": [average], "n": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, average double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)
