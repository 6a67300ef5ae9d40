"""Tables between the steps of a job, in the folder that driver and executors share.

``spark.checkpoint.dir`` names it. Only where that is unset and Spark runs in one process (tests, a
laptop) is a temporary folder made instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings under which steps are written: shuffles go with their step, and batches for Python workers are bounded in bytes, however long texts are.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def folder(spark: SparkSession) -> str:
    """URI of the shared folder."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder, not made yet, below the shared one."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gives its shuffle files up as soon as it ends, not when the driver happens to collect its garbage, and sends Python small batches."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a Parquet table in the shared folder: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    with lean(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Tables of so many rows at most are sent to all tasks instead of dealing all claims by their key: some 40 MB of sources, 60 MB of keys of claims.
SMALL_ROWS = 500_000


def few(table: DataFrame) -> bool:
    return table.count() <= SMALL_ROWS


def small(table: DataFrame, otherwise: str | None = None) -> DataFrame:
    """A table to be broadcast if its rows are few; of a larger one the planner deals both sides, by the hint given."""
    if few(table):
        return F.broadcast(table)
    return table.hint(otherwise) if otherwise else table


def removed(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more; what can't be reached from here stays."""
    for table in tables:
        try:
            system, path = fs.FileSystem.from_uri(table.scratch_path)
            system.delete_dir(path)
        except (OSError, ValueError):
            continue
