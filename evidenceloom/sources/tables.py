"""Writing: appends, upserts, versioned swaps, seeds."""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenceloom.operators.evidence import newest


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], update: bool = True) -> DataFrame:
    """Rows by key: the new ones win if update, else what is there stays. Within either, the first by order."""
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return newest(both, keys, [F.col("_new").desc() if update else F.col("_new"), *order]).drop("_new")


class Conflict(Exception):
    """Someone else made the version that this one was to follow."""


def create_once(spark: SparkSession, uri: str, content: bytes) -> bool:
    """Makes a file unless it is there; of several who try at once, one makes it. Local disks decide by exclusive creation, HDFS and the like by creation without overwriting."""
    scheme, _, rest = uri.partition("://")
    if not rest or scheme == "file":
        path = rest or uri
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        try:
            os.link(part, path)  # whole or not at all
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(path, False)
    except Exception as e:  # noqa: BLE001
        if system.exists(path):
            return False
        raise e
    out.write(bytearray(content))
    out.close()
    return True


class Versioned:
    """A table that readers see whole: each version is a folder, and numbered pointer files say which count.

    A version counts when the pointer of the next number was made, which only one writer can do. One who finds it made
    has read an older version than the newest: update() reads again and tries again, swap() with an expected number gives up. So no
    version is lost, and a reader of any number sees the same rows for ever.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.system, self.root = fs.FileSystem.from_uri(self.path)

    def exists(self, uri: str) -> bool:
        return self.system.get_file_info(fs.FileSystem.from_uri(uri)[1]).type == fs.FileType.File

    def number(self) -> int:
        """Of the newest version; 0: none yet."""
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/versions", allow_not_found=True))
        return max((int(f.base_name) for f in found if f.base_name.isdigit()), default=0)

    def folder(self, number: int) -> str:
        with self.system.open_input_stream(f"{self.root}/versions/{number:012d}") as f:
            return f.read().decode()

    def current(self) -> str | None:
        n = self.number()
        return self.folder(n) if n else None

    def swap(self, df: DataFrame, after: int | None = None) -> int:
        """Writes a version and makes it the newest; its number. after: the version that it must follow."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        while True:
            number = (self.number() if after is None else after) + 1
            if create_once(self.spark, f"{self.path}/versions/{number:012d}", name.encode()):
                return number
            if after is not None:
                self.system.delete_dir(f"{self.root}/{name}")
                raise Conflict(f"{self.path} already has version {number}")

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
        """Makes the next version from the newest, again if another writer was first."""
        for n in range(tries):
            base = self.number()
            try:
                return self.swap(change(self.read(base) if base else None), base)
            except Conflict:
                time.sleep(random.random() * min(2**n, 50) / 100)
        raise Conflict(f"{self.path}: other writers were first {tries} times")

    def read(self, number: int | None = None) -> DataFrame:
        number = number or self.number()
        if not number:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/{self.folder(number)}")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the rows of all but the newest versions; their numbers stay taken. Folders that are no version stay: their writers may be at work."""
        for n in range(self.number() - keep, 0, -1):
            old = f"{self.root}/{self.folder(n)}"
            if self.system.get_file_info(old).type == fs.FileType.NotFound:
                break  # what is older went before
            self.system.delete_dir(old)


def csv_file(df: DataFrame, path: str) -> None:
    """Rows for people's eyes as one CSV file with a header, in the rows' order; for reports and review lists, which are short."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def text_file(lines: DataFrame, path: str, column: str = "line") -> None:
    """One text file of a column's lines, in the rows' order."""
    lines.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def review_list(asked: DataFrame, proposals: DataFrame) -> DataFrame:
    """What a rebuild leaves for people, as lines: pairs without a verdict, and venues that a merge found different."""
    pairs = asked.select(F.concat_ws(" ", F.lit("same?"), F.col("a"), F.lit("<>"), F.col("b"), F.concat(F.lit("["), F.col("key"), F.lit("]"))).alias("line"))
    venues = proposals.where("proposal = 'review'").select(F.concat_ws(" ", F.lit("venue?"), F.col("venue").cast("string"), F.lit("<>"), F.col("name")).alias("line"))
    return pairs.union(venues).orderBy("line")


def seed_venues(spark: SparkSession, path: str) -> DataFrame:
    """name, aliases (separated by bars), kind, lat, lon."""
    rows = spark.read.csv(path, header=True, schema="name string, aliases string, kind string, lat double, lon double")
    return rows.withColumn("aliases", F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: a != ""))


def seed_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="name string, url string, kind string, entity_type string, tier int, trust double, lat double, lon double")
