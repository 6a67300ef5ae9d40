"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Texts and items are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
``width`` consecutive words of an item; an item with fewer words, but not none, is one window. The
windows' 64-bit hashes and words are broadcast if they are ``BROADCAST_WINDOWS`` and ``BROADCAST_BYTES`` at most, which is checked; a word
of over ``LONG`` bytes (a text without blanks, in scripts that have none) stands there by its sha256, so no item is larger than its
number of words says. A larger benchmark is taken in groups of so much, a pass over the documents for each (a large item is split between windows): the words
hit so far go on in a written table and the group's broadcast is given up before the next.
Each hash that is found is verified against the words themselves, so equal hashes of different windows
do not count.

Defined results: null and empty texts have no words and no hits; null items are ignored, items with
the same text each count; repeated rows of documents get equal results; an empty benchmark hits
nothing; further columns of documents pass through (names that clash get a leading underscore).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as X
from .columns import free, pick
from .shared import written

WIDTH = 10
#: Windows of a benchmark that are broadcast at once: 16 bytes each and the words that they begin with.
BROADCAST_WINDOWS = 200_000
#: Bytes of words that are broadcast at once, but for a last item's; and of a word that stands there as it is.
BROADCAST_BYTES, LONG = 32 << 20, 64


class Windows:
    """Windows of a benchmark's items, by width: their sorted hashes, and where each stands.

    Items' words are kept once, as bytes with a zero byte behind each, so a window costs 16 bytes beside them.
    """

    def __init__(self, rows: list[tuple[str, bytes, np.ndarray]], width: int = WIDTH):
        """rows: item, its lower-cased words as they are kept, a zero byte behind each, and the words' hashes."""
        self.items = [row[0] for row in rows]
        self.words = [row[1] for row in rows]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.ends: list[np.ndarray] = []
        for n, (_, words, own) in enumerate(rows):
            self.ends.append(np.flatnonzero(np.frombuffer(words, np.uint8) == 0).astype(np.int32))
            size = min(width, len(own))
            hashes, at = X.window_hashes(own, np.zeros(len(own), np.int64), size)
            found.setdefault(size, []).append((hashes, np.full(len(at), n, np.int32), at.astype(np.int32)))
        self.by_width = {}
        for size, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_width[size] = (h[order], item[order], at[order])

    def _window(self, item: int, at: int, width: int) -> bytes:
        ends = self.ends[item]
        return self.words[item][int(ends[at - 1]) + 1 if at else 0 : int(ends[at + width - 1])]

    def hits(self, low: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray):
        """Which words are hit, and the pairs (text, item) with an occurrence."""
        hit, pairs = np.zeros(len(starts), dtype=bool), set()
        for width, (known, items, places) in self.by_width.items():
            h, at = X.window_hashes(hashes, owner, width)
            if not len(h):
                continue
            first = np.searchsorted(known, h)
            some = np.flatnonzero(known[np.minimum(first, len(known) - 1)] == h)
            for j, a, z in zip(some.tolist(), first[some].tolist(), np.searchsorted(known, h[some], side="right").tolist(), strict=True):
                i = int(at[j])
                own = b"\0".join(_kept(low[starts[x] : ends[x]].tobytes()) for x in range(i, i + width))
                for k in range(a, z):
                    if own == self._window(int(items[k]), int(places[k]), width):
                        hit[i : i + width] = True
                        pairs.add((int(owner[i]), int(items[k])))
        return hit, pairs


def _kept(word: bytes) -> bytes:
    """A word, or for a long one its sha256 behind a byte that no word has."""
    return word if len(word) <= LONG else b"\1" + hashlib.sha256(word).hexdigest().encode()


def _words(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words as they are kept, and their hashes."""
    buf, offs = X.flat(pa.array([text]))
    low = X.LOWER[buf]
    starts, ends, _ = X.spans(low, offs, X.ALNUM)
    raw = low.tobytes()
    return [_kept(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], X.span_hashes(X.prefix_sums(low), starts, ends)


def _groups(benchmark: DataFrame, width: int, limit: int, most_bytes: int) -> Iterator[list[tuple[str, bytes, np.ndarray]]]:
    """The items' words in groups of at most limit windows and about so many bytes, in the order of their ids; an item of more is split, windows that cross a cut are on both sides' account."""
    group, size, held = [], 0, 0
    for r in benchmark.toLocalIterator():
        words, hashes = _words(r["text"])
        a = 0
        while a < len(words):
            if size >= limit or held >= most_bytes:
                yield group
                group, size, held = [], 0, 0
            room = max(1, (most_bytes - held) // (LONG + 2))  # words of any kind that have room
            n = min(limit - size, room, max(1, len(words) - a - width + 1))  # windows that begin from here
            z = min(len(words), a + n + width - 1)
            own = b"".join(w + b"\0" for w in words[a:z])
            group.append((r["item_id"], own, hashes[a:z]))
            size, held = size + n, held + len(own)
            a = a + n if z < len(words) else len(words)
    if group:
        yield group


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    limit: int = BROADCAST_WINDOWS,
    most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted) and kept_text (words hit, and what stands between two of them, cut out)."""
    spark = docs.sparkSession
    rows = pick(benchmark, item_id=item_id, text=item_text).where("text is not null").select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text")
    words, found = free(docs, "hit_words"), free(docs, "hit_items")
    groups = _groups(rows, width, limit, most_bytes)
    group, now = next(groups, []), docs
    while (after := next(groups, None)) is not None:
        sent = spark.sparkContext.broadcast(Windows(group, width))
        now = written(_pass(now, text, sent, words, found), "words-hit")
        sent.unpersist()
        group = after
    hit = _pass(now, text, spark.sparkContext.broadcast(Windows(group, width)), words, found)
    names = [free(docs, n) for n in ("n_words", "n_hit", "items", "kept_text")]
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.ArrayType(T.StringType())), T.StructField(names[3], T.StringType())])
    return hit.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{words}.n").alias(names[0]), F.size(f"{words}.hit").cast("long").alias(names[1]), F.array_sort(F.array_distinct(found)).alias(names[2]), F.coalesce(f"{words}.kept", F.col(f"`{text}`")).alias(names[3])).to(schema)


def _pass(docs: DataFrame, text: str, sent, words: str, found: str) -> DataFrame:
    """docs with words (their number, those hit by any group so far, and what is left of a text with hits) and items found."""
    again = words in docs.columns
    first = [f for f in docs.schema if f.name not in (words, found)]
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("kept", T.StringType())])
    schema = T.StructType([*first, T.StructField(words, kind), T.StructField(found, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            buf, offs = X.flat(batch.column(at(text)))
            counts = np.zeros(batch.num_rows, np.int64)
            hits: list[np.ndarray | list[int]] = [x["hit"] for x in batch.column(at(words)).to_pylist()] if again else [[] for _ in range(batch.num_rows)]
            items = batch.column(at(found)).to_pylist() if again else [[] for _ in range(batch.num_rows)]
            kept: list[str | None] = [None] * batch.num_rows
            for a, b in X.pieces(offs):
                low, o = X.LOWER[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
                starts, ends, owner = X.spans(low, o, X.ALNUM)
                counts[a:b] = np.bincount(owner, minlength=b - a)
                begin = np.searchsorted(owner, np.arange(b - a + 1))
                hit, pairs = sent.value.hits(low, X.span_hashes(X.prefix_sums(low), starts, ends), starts, ends, owner)
                for doc in range(b - a) if again else ():
                    hit[begin[doc] + np.array(hits[a + doc], dtype=np.int64)] = True
                for doc, item in pairs:
                    items[a + doc].append(sent.value.items[item])
                for doc in np.unique(owner[hit]).tolist():
                    s = slice(begin[doc], begin[doc + 1])
                    hits[a + doc] = np.flatnonzero(hit[s]).tolist()
                    kept[a + doc] = _without(buf[offs[a + doc] : offs[a + doc + 1]].tobytes(), starts[s] - o[doc], ends[s] - o[doc], hit[s])
            structs = pa.StructArray.from_arrays([pa.array(counts), pa.array(hits, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["n", "hit", "kept"])
            yield pa.RecordBatch.from_arrays([*(batch.column(at(f.name)) for f in first), structs, pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(raw[at : int(starts[first])])
        at = int(ends[stop - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")



_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Counts and items' digest over the tables documents and benchmark, for DuckDB; windows are compared by their words.
SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_LOW} AS ws FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, ws, least({WIDTH}, len(ws)) AS k FROM items WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, k, array_to_string(ws[i + 1 : i + k], ' ') AS win FROM (SELECT item, k, ws, unnest(range(len(ws) - k + 1)) AS i FROM sized)),
dw AS (SELECT r, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS win FROM (SELECT r, k, ws, unnest(range(greatest(len(ws) - k + 1, 0))) AS i FROM w, (SELECT DISTINCT k FROM iw))),
hits AS (SELECT r, i, k, item FROM dw JOIN iw USING (k, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
