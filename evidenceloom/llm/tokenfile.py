"""Token ids in Arrow stream files of equal-length sequences.

A shard is one file in Arrow's stream format. Each record batch has ``ids`` (fixed-size list of
``seq_len`` unsigned integers, of 16 bits if the tokenizer's vocabulary allows it), ``mask`` (fixed-size list of as many booleans, false where the shard's last
sequence is padded) and ``docs`` (the documents that begin in the batch: id, place in the shard, number
of tokens). Batches hold ``BATCH`` sequences and are written uncompressed, so that a reader maps the
file and gets sequence i at ``i // BATCH``, ``i % BATCH`` without copying, ids and mask alike (see ``Shard``): Arrow keeps
booleans as bits, and as seq_len is a multiple of eight, each sequence's bits begin with a byte.

Documents are spread by ranges of their id, so that file names and rows are in ascending id order, and
each task tokenises, writes and forgets one batch of rows after another. Tokenising: a text is cut at
blanks, newlines and before ASCII signs that follow an ASCII letter or digit, A-Z is lower-cased, and each
distinct word is encoded once. This equals encoding the whole text for a tokenizer that lower-cases,
drops white space and takes runs of letters, single digits and runs of other signs apart; texts near a
``<|``, which may begin a special token, are only cut at white space. Whether a tokenizer is such a one is
read from its file (``cuts_at_words``); with any other, whole texts are encoded.

Defined results: null and empty texts have the end id only; null ids come first; rows with equal ids
are ordered by text; repeated rows stay; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as X
from .columns import pick
from .shared import AtomicFile, opened, scratch, written

SEQ_LEN, BATCH = 2048, 64
_ENDS = X._table(b" \n")
_SIGN, _WORD = X._table(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), X._table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B)]))
#: Bytes of text that are tokenised at once.
TEXT = 4 << 20
#: Distinct words whose ids a worker remembers.
REMEMBERED = 700_000


#: Normalisers that change no more than spelling, case and kind of white space; a pattern of words; what may follow it.
_NORMAL = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_at_words(tokenizer: dict) -> bool:
    """Whether encoding a text equals encoding its words, by a tokenizer's file."""
    normal, before = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    first, *rest = before.get("pretokenizers") or [{}]
    return (
        tuple(normal.get("normalizers") or ()) == _NORMAL
        and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": _PATTERN}, "Removed", True)
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
        and all(t["content"].startswith("<|") and not t["normalized"] for t in tokenizer.get("added_tokens") or ())
    )


def loaded(path: str) -> bytes:
    """A tokenizer's file."""
    system, path = opened(path if "://" in path else os.path.abspath(path))
    with system.open_input_stream(path) as f:
        return f.read()


class WordEncoder:
    """Ids of texts, by way of their words where the tokenizer allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        content = loaded(path)
        self.tokenizer, self.by_words = Tokenizer.from_buffer(content), cuts_at_words(json.loads(content))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.begin = np.zeros(REMEMBERED * 2, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        if n + len(words) + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros(len(self.begin) + len(words), np.int64)))
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)]
            ends = self.begin[n] + np.cumsum([len(x) for x in found])
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            self.ids[self.begin[n] : ends[-1]] = list(chain.from_iterable(found))
            self.begin[n + 1 : n + 1 + len(part)] = ends
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            n += len(part)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's offsets among them."""
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        if not self.by_words:
            return self._whole(buf.tobytes(), offs)
        cut = np.zeros(len(buf), dtype=bool)
        cut[offs[:-1][offs[:-1] < len(buf)]] = True
        if b"<|" not in buf.tobytes():  # special tokens are found in the text as it stands
            buf = X.LOWER[buf]
            cut[1:] |= _SIGN[buf[1:]] & _WORD[buf[:-1]]
        inside = ~_ENDS[buf]
        cut[1:] |= inside[1:] & ~inside[:-1]
        place = np.concatenate(([0], np.cumsum(inside)))
        at = place[np.flatnonzero(cut)]
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        offs, buf = place[offs], buf[inside]
        at = at[at < len(buf)]
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        self._learn([w for w in distinct if w not in known])
        which = np.array([known[w] for w in distinct], dtype=np.int64)[coded.indices.to_numpy()]
        n = self.begin[which + 1] - self.begin[which]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.begin[which] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(at, offs)]


    def _whole(self, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.cumsum([0, *map(len, found)])


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class _Writer:
    """Fills sequences and hands out full batches."""

    def __init__(self, stream, seq_len: int, dtype):
        self.seq_len, self.dtype, self.n_tokens, self.n_docs = seq_len, np.dtype(dtype), 0, 0
        of = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema({"ids": pa.list_(of, seq_len), "mask": pa.list_(pa.bool_(), seq_len), "docs": pa.list_(pa.struct({"doc_id": pa.int64(), "place": pa.int64(), "n_tokens": pa.int64()}))})
        self.out = pa.ipc.new_stream(stream, self.schema)
        self.held: list[np.ndarray] = []
        self.held_n = 0
        self.docs: list[dict] = []

    def add(self, doc_ids: list, ids: np.ndarray, offs: np.ndarray) -> None:
        for doc, a, n in zip(doc_ids, offs[:-1].tolist(), np.diff(offs).tolist(), strict=True):
            self.docs.append({"doc_id": doc, "place": self.n_tokens + a, "n_tokens": n})
        self.n_tokens += len(ids)
        self.n_docs += len(doc_ids)
        self.held.append(ids.astype(self.dtype))
        self.held_n += len(ids)
        size = self.seq_len * BATCH
        if self.held_n >= size:
            data = np.concatenate(self.held)
            whole = len(data) // size * size
            for i in range(0, whole, size):
                self._batch(data[i : i + size], size)
            self.held, self.held_n = [data[whole:]], len(data) - whole

    def _batch(self, data: np.ndarray, real: int) -> None:
        rows = len(data) // self.seq_len
        mask = np.zeros(len(data), dtype=bool)
        mask[:real] = True
        docs = pa.array([self.docs if i == 0 else [] for i in range(rows)], self.schema.field("docs").type)
        ids = pa.FixedSizeListArray.from_arrays(pa.array(data), self.seq_len)
        self.out.write_batch(pa.record_batch([ids, pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len), docs], schema=self.schema))
        self.docs = []

    def close(self) -> None:
        data = np.concatenate([*self.held, np.empty(0, self.dtype)])
        if len(data) or self.docs:
            self._batch(np.concatenate([data, np.zeros(-len(data) % self.seq_len, self.dtype)]), len(data))
        self.out.close()


def largest_id(path: str) -> int:
    """The largest id that a tokenizer gives."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_buffer(loaded(path)).get_vocab(with_added_tokens=True).values(), default=0)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes shards below path; the manifest has shard, path, n_docs, n_tokens and start (tokens of all shards before)."""
    if seq_len % 8:
        raise ValueError("seq_len must be a multiple of eight, so that masks begin with a byte")
    rows = pick(docs, doc_id=doc_id, text=text)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dtype = np.uint16 if max(largest_id(tokenizer), end_id) < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"{path}/{uuid.uuid4().hex}.arrows"
        with AtomicFile(name) as stream:
            out = _Writer(stream, seq_len, dtype)
            for batch in chain([first], batches):
                _add(out, batch, encode, end_id)
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.n_docs]), pa.array([out.n_tokens])], names=["path", "n_docs", "n_tokens"])

    spread = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    shards = written(spread.mapInArrow(run, "path string, n_docs long, n_tokens long").withColumn("part", F.spark_partition_id()), "token-shards")
    # one row for each shard, in the order of the ranges
    order = Window.orderBy("part")
    return shards.withColumns({"shard": F.row_number().over(order) - 1, "start": F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).select("shard", "path", "n_docs", "n_tokens", "start")


def _add(out: _Writer, batch: pa.RecordBatch, encode: WordEncoder, end_id: int) -> None:
    buf, offs = X.flat(batch.column(1))
    doc_ids = batch.column(0).to_pylist()
    for a, b in X.pieces(offs, TEXT):
        ids, o = encode(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        out.add(doc_ids[a:b], np.insert(ids, o[1:], end_id), o + np.arange(b - a + 1))


class Shard:
    """Random access to a shard on a local disk, without copying: the file is mapped."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.batches = pa.ipc.open_stream(self.map).read_all().to_batches()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, both views of the file; the mask as bytes of eight bits each, the first the lowest (see ``unpacked``)."""
        b, row = self.batches[i // BATCH], i % BATCH
        ids, bits = b.column(0), b.column(1)
        n = ids.type.list_size
        begin = (bits.offset + row) * n + bits.values.offset
        return ids[row].values.to_numpy(), np.frombuffer(bits.values.buffers()[1], np.uint8, n // 8, begin // 8)


def unpacked(mask: np.ndarray) -> np.ndarray:
    """A mask's bits as booleans."""
    return np.unpackbits(mask, bitorder="little").astype(bool)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _documents(path, start)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, start: int) -> Iterator[pa.RecordBatch]:
    """The documents of a shard; holds one batch and the document that goes on after it."""
    system, path = opened(path)
    rows, crc, n = [], 0, 0
    with system.open_input_stream(path) as f:
        waiting: list[dict] = []
        place = 0
        for batch in pa.ipc.open_stream(f):
            data = batch.column(0).flatten().to_numpy().astype("<u4")
            waiting += batch.column(2).flatten().to_pylist()
            end = place + len(data)
            while waiting:
                d = waiting[0]
                a, b = max(d["place"] + n, place), min(d["place"] + d["n_tokens"], end)
                crc, n = zlib.crc32(data[a - place : b - place], crc), n + b - a
                if n < d["n_tokens"]:
                    break
                rows.append((d["doc_id"], start + d["place"], n, crc))
                waiting.pop(0)
                crc = n = 0
            place = end
            if len(rows) >= 5000:
                yield _rows(rows)
                rows = []
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **more) -> DataFrame:
    """Writes docs into the shared folder and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch(spark, "tokens"), tokenizer, end_id, **more))
