"""Blocks of documents in the shared folder, and what they tell each other about common hashes.

A block is an Arrow file of consecutive rows with about ``BLOCK`` bytes of text. Passes over the corpus
read blocks by themselves, from a table of their names, so the texts go through Spark once. A block
asks about hashes in bulk: it sends, for each of ``parts`` ranges of hashes, one row with arrays packed
as bytes; equal hashes are merged in the block before (a hot word or passage costs an entry a
block). The task that has a range sees all blocks' entries for it and answers each block in the order of
its entries. A range's size is bounded by the number of ranges, which follows the input; nothing but
sums comes to the driver. Blocks and answers are named by a manifest that Spark wrote, so lost executors
only repeat work, and files of tasks that ran twice are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as X
from .shared import AtomicFile, opened, scratch, written

BLOCK = 8 << 20


def make(df: DataFrame, text: str = "text") -> DataFrame:
    """block (URI of the file), n_rows and n_bytes of the blocks of df's rows."""
    path = scratch(df.sparkSession, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            offs = X.flat(column)[1]
            for a, b in X.pieces(offs, 1 << 20):
                held.append(batch.slice(a, b - a))
                size += int(offs[b] - offs[a])
                if size >= BLOCK:
                    yield _store(path, held, size)
                    held, size = [], 0
        if held:
            yield _store(path, held, size)

    return written(df.mapInArrow(run, "block string, n_rows long, n_bytes long"), "block-list")


def _store(path: str, batches: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    name = f"{path}/{uuid.uuid4().hex}"
    save(name, pa.Table.from_batches(batches))
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(b.num_rows for b in batches)]), pa.array([size])], names=["block", "n_rows", "n_bytes"])


def save(uri: str, table: pa.Table) -> None:
    with AtomicFile(uri) as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table, max_chunksize=4096)


def load(uri: str) -> pa.Table:
    system, path = opened(uri)
    with system.open_input_stream(path) as f:
        return pa.ipc.open_stream(f).read_all()


def spread(df: DataFrame, blocks_of: str = "block") -> DataFrame:
    """Dealt out over all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks_of)


def parts_for(blocks: DataFrame, bytes_for_each: int = 4 << 20) -> int:
    """Ranges of hashes, so that each gets what so many bytes of text send; 96 at least, for as many tasks."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(96, int(total // bytes_for_each))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range of each hash: bits in the middle times parts, so that it goes well with sorting by the whole hash."""
    return ((hashes >> X.U(32)) * X.U(parts) >> X.U(32)).astype(np.int64)


def cut_by_part(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each range begins and ends among sorted hashes."""
    return np.searchsorted(part_of(sorted_hashes, parts), np.arange(parts + 1))


def sent(blocks: DataFrame, send: Callable[[str], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """part, block and blob of what send yields for each block's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = list(send(name))
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows[i : i + 64]], pa.int32()), pa.array([name] * len(rows[i : i + 64])), pa.array([b for _, b in rows[i : i + 64]], pa.binary())], names=["part", "block", "blob"])

    return spread(blocks.select("block")).mapInArrow(run, "part int, block string, blob binary")


def answered(asked: DataFrame, answer: Callable[[list[bytes]], tuple[list[bytes], bytes]]) -> DataFrame:
    """block, part and blob of the answers, and rows without a block for what answer says besides."""

    def run(table: pa.Table) -> pa.Table:
        part, names = table.column(0)[0].as_py(), table.column(1).to_pylist()
        replies, more = answer(table.column(2).to_pylist())
        return pa.table({"block": pa.array([*names, None], pa.string()), "part": pa.array([part] * (len(names) + 1), pa.int32()), "blob": pa.array([*replies, more], pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "block string, part int, blob binary")


def stored(answers: DataFrame, blocks: DataFrame, kind: str) -> DataFrame:
    """The blocks, each with its answers beside it in ``<block>.<kind>`` (part and blob, by part; no file: no answers)."""

    def run(table: pa.Table) -> pa.Table:
        name = table.column("block")[0].as_py()
        save(f"{name}.{kind}", table.select(["part", "blob"]).sort_by("part"))
        return pa.table({"block": [name], "stored": [True]})

    done = answers.where("block is not null").groupBy("block").applyInArrow(run, "block string, stored boolean")
    return written(blocks.select("block").join(done, "block", "left"), f"blocks-{kind}")


def answers_of(name: str, kind: str) -> dict[int, bytes]:
    """A block's answers by part."""
    system, path = opened(f"{name}.{kind}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    table = load(f"{name}.{kind}")
    return dict(zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True))
