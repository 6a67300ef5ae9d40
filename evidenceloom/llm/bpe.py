"""Byte-level BPE over overlapping chunks, and back.

A text of up to ``CHUNK`` code points is one piece. A longer one is cut into chunks of ``CHUNK`` code
points that reach ``OVERLAP`` further, each a row that any task may take. A chunk is pre-tokenised by
itself; as the pattern looks ahead only, two tokenisations that share one boundary agree from there
on. The first boundary that both chunks have in their overlap is the seam, if the chunk before has
seen enough behind it and no white space stands before it (a white-space token depends on what
follows). Between seams the pieces are encoded independently, and
the ids of a text's pieces are put together. Decoding concatenates each id's bytes.

Defined results: null and empty texts have no ids and decode to an empty string; repeated rows get
equal results; empty tables give empty ones; further columns pass through (clashing names get a
leading underscore). From a chunk without a seam on (an endless word), the rest of a text is one piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free
from .shared import opened

CHUNK, OVERLAP = 32_768, 512
#: Code points that the chunk before must have seen from a seam on.
SEEN = 4


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a file that every executor can read (a path or a URI)."""
    if "://" in path:
        system, path = opened(path)
        with system.open_input_stream(path) as f:
            lines = f.read().splitlines()
    else:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(2)
def _bytes(path: str) -> list[bytes]:
    table = [b""] * (max(ranks(path).values()) + 1)
    for token, i in ranks(path).items():
        table[i] = token
    return table


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)))


def _encoded(texts: list[str | None], path: str, pattern: str) -> pa.Array:
    e = encoder(path, pattern)
    return _lists([np.asarray(e.encode_ordinary(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in texts])


def boundaries(chunk: str, pattern: regex.Pattern, stop: int | None = None) -> Iterator[int]:
    """Ends of the pre-tokens, but those that white space stands before; 0 is one as well."""
    yield 0
    for m in pattern.finditer(chunk):
        if not chunk[m.end() - 1].isspace():
            yield m.end()
        if stop is not None and m.end() > stop:
            return


class Step:
    """What is done to a table's record batches: the new schema, and the batches' iterator."""

    def __init__(self, schema: Callable[[T.StructType], T.StructType], run: Callable[[Iterator[pa.RecordBatch], list[str]], Iterator[pa.RecordBatch]]):
        self.schema, self.run = schema, run


def apply(df: DataFrame, *steps: Step) -> DataFrame:
    """All steps in one worker, so that what they hand on stays there."""
    schemas = [df.schema]
    for s in steps:
        schemas.append(s.schema(schemas[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256))
        for s, schema in zip(steps, schemas[1:], strict=True):
            parts = s.run(parts, schema.names)
        return parts

    return df.mapInArrow(run, schemas[-1]) if steps else df


def _added(*fields: tuple[str, T.DataType]):
    def schema(old: T.StructType) -> T.StructType:
        out = old
        for name, kind in fields:
            out = T.StructType([*out, T.StructField(free(out, name), kind)])
        return out

    return schema


def encoding(path: str, pattern: str, text: str = "text") -> Step:
    """Adds token_ids."""

    def run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _encoded(batch.column(batch.schema.get_field_index(text)).to_pylist(), path, pattern)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=names)

    return Step(_added(("token_ids", T.ArrayType(T.IntegerType()))), run)


def decoding(path: str, ids: str = "token_ids") -> Step:
    """Adds decoded, the concatenated bytes of the ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        table = _bytes(path)
        for batch in batches:
            found = (x.values.to_pylist() if x.is_valid else [] for x in batch.column(batch.schema.get_field_index(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join([table[t] for t in x]) for x in found], pa.binary())], names=names)

    return Step(_added(("decoded", T.BinaryType())), run)


def digesting(ids: str = "token_ids", decoded: str = "decoded") -> Step:
    """Adds n_tokens, ids_sha256 (over the ids as little-endian unsigned 32-bit integers) and decoded_sha256, and takes ids and bytes away."""

    def schema(old: T.StructType) -> T.StructType:
        kept = T.StructType([f for f in old if f.name not in (ids, decoded)])
        return _added(("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))(kept)

    def run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = [np.asarray(x.values.to_numpy() if x.is_valid else [], dtype="<u4") for x in batch.column(at(ids))]
            hashes = [[hashlib.sha256(x).hexdigest() for x in values] for values in (found, batch.column(at(decoded)).to_pylist())]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in found], pa.int64()), *map(pa.array, hashes)], names=names)

    return Step(schema, run)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, then: tuple[Step, ...] = ()) -> DataFrame:
    """docs with token_ids, as encoding the whole text would give them, and what then makes of that."""
    is_long = F.coalesce(F.length(F.col(f"`{text}`")) > chunk, F.lit(False))
    short = apply(docs.where(~is_long), encoding(path, pattern, text), *then)
    key = free(docs.schema, "text_key")
    long = docs.where(is_long).withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    # equal long texts are encoded once
    ids = encode_long(long.groupBy(F.col(f"`{key}`").alias("key")).agg(F.first(F.col(f"`{text}`")).alias("text")), path, pattern, chunk, overlap)
    joined = long.join(ids.withColumnsRenamed({"key": f"{key}_", "token_ids": f"{key}_ids"}), F.col(f"`{key}`") == F.col(f"`{key}_`"))
    name = free(docs.schema, "token_ids")
    return short.unionAll(apply(joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{key}_ids`").alias(name)), *then))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, encoded and decoded: n_tokens, ids_sha256 and decoded_sha256."""
    ids, decoded = free(docs, "token_ids"), free(docs, "decoded")
    without = Step(lambda old: T.StructType([f for f in old if f.name != text]), lambda batches, names: (b.select(names) for b in batches))
    return encode(docs, path, pattern, text, then=(decoding(path, ids), without, digesting(ids, decoded)))


def encode_long(texts: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and token_ids of (key, text), the keys all different, by way of chunks that lie in any partition."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = range(0, len(text), chunk)
                for i in range(0, len(at), 64):
                    part = at[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array([a // chunk for a in part], pa.int64()), pa.array([text[a : a + chunk + overlap] for a in part])], names=["key", "i", "text"])

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(2).to_pylist():
                ends = list(boundaries(text, compiled))
                heads.append([p for p in ends if p <= overlap - SEEN])
                tails.append([p - chunk for p in ends if chunk <= p <= len(text) - SEEN])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["key", "i", "text", "head", "tail"])

    rows = texts.select("key", "text").mapInArrow(chunks, "key string, i long, text string")
    cut = rows.repartition("key", "i").mapInArrow(seams, "key string, i long, text string, head array<int>, tail array<int>")
    by = Window.partitionBy("key").orderBy("i")
    cut = cut.withColumn("seam", F.when(F.col("i") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by)))))
    # a chunk's boundaries are those of the whole text only if it and all before it have a seam
    cut = cut.withColumn("seam", F.when(F.every(F.col("seam").isNotNull()).over(by), F.col("seam")))
    cut = cut.withColumns({"run": F.count("seam").over(by), "next": F.lead("seam").over(by), "last": F.lead("i").over(by).isNull()})
    start = F.coalesce("seam", F.lit(0))
    stop = F.when(F.col("last"), F.length("text")).otherwise(chunk + F.coalesce("next", F.lit(0)))
    piece = F.substring("text", start + 1, stop - start)
    pieces = cut.groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("t")))).alias("p")).select("key", "run", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _encoded(batch.column(2).to_pylist(), path, pattern)], names=["key", "run", "ids"])

    ids = pieces.mapInArrow(encoded, "key string, run long, ids array<int>")
    return ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("p")).select("key", F.flatten(F.transform("p", lambda x: x["ids"])).alias("token_ids"))


def decode(docs: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """docs with decoded, the bytes of their token ids (null: empty)."""
    return apply(docs, decoding(path, ids))
