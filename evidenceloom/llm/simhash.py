"""SimHash near-dedup with pivot distance tables.

Fingerprint: bit b of 64 is 1 if bit b of over half of the shingles' XXH64 (seed 42) hashes is. Equal
fingerprints are one node. Two ways to the links:

``max_bits`` (2 at most, exact): two fingerprints that differ in two bits at most agree in two of four
16-bit blocks, so each fingerprint gets a row for each of the six pairs of blocks. Rows of one key are
sorted together and compared in numpy: a table of Hamming distances to ``PIVOTS`` reference
fingerprints discards pairs of which one coordinate differs by more than max_bits (each pivot's
distance changes by one at most with each bit), and the survivors are verified by XOR. A key with over
``MOST`` rows is split by two more of four 8-bit blocks of what the key leaves open; then at most 2**16
fingerprints share a key, and these are looked up by flipping each of 136 one- and two-bit masks, so no
group is compared with all of itself.

``similarity`` (Jaccard, on sets of shingles; the fingerprint here is of the distinct shingles): 64 bits are too few for that. At 0.8 two fingerprints
differ in 10 bits in the mean and in up to 20, where a pivot table discards next to nothing and no
choice of equal blocks is selective; so candidates come from ``BANDS`` keys of ``ROWS`` minimum hashes each
(at 0.8 a pair is missed with a chance of 7e-5, at 0.9 of 1e-9), pivot tables over the fingerprints drop
what is out of ``reach``, and the shingle sets themselves decide. Candidates are not all pairs: in each
group all link to its first member and to their next ones; a second round compares what is left of
a group in different components, so that no verified link between two components is missing.

Components are found by sending labels to the smallest neighbour and along stars, with a written
table each round. Nothing about single documents comes to the driver.

Defined results: null and empty texts have no words, fingerprint zero in the first form (linked like
any other) and no link in the second; null ids are no component's smallest unless all are null (then
the component id is null); repeated rows stay and share a component; further columns pass through
(clashing names get a leading underscore); empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenceloom.operators.components import components

from . import textnum as X
from .columns import free
from .shared import written

SEED = 42
PIVOTS = 16
#: Rows of a key that are compared with each other.
MOST = 256
#: Stands for a null id.
_LAST = 9223372036854775807
_PIVOTS = X.mix(np.arange(1, PIVOTS + 1, dtype=X.U) * X.U(0x2545F4914F6CDD1D))


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one blank after each; starts, ends and owners of the words there."""
    low = X.LOWER[buf]
    starts, ends, owner = X.spans(low, offs, X.NOT_SPACE)
    if not len(starts):
        return b"", starts, ends, owner
    n = ends - starts
    stop = np.cumsum(n + 1)
    begin = stop - n - 1
    at = np.repeat(starts - begin, n + 1) + np.arange(stop[-1])
    out = low[np.minimum(at, len(low) - 1)]
    out[stop - 1] = 0x20
    return out.tobytes(), begin, begin + n, owner


def shingle_spans(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of windows of so many words, or of all words of a shorter text."""
    if not len(owner):
        return starts, ends, owner
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(first, len(owner)))
    short = first[counts < width]
    n = max(0, len(owner) - width + 1)
    full = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n else np.empty(0, np.int64)
    a = np.concatenate((full, short))
    z = np.concatenate((full + width - 1, short + counts[counts < width] - 1))
    order = np.argsort(a, kind="stable")
    return starts[a[order]], ends[z[order]], owner[a[order]]


def fingerprints(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprint of each text, and all shingles' hashes and owners."""
    out = np.zeros(len(offs) - 1, dtype=X.U)
    text, *words = normalised(buf, offs)
    s, e, owner = shingle_spans(*words, width)
    if not len(s):
        return out, np.empty(0, X.U), owner
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(text[a:b], SEED) for a, b in zip(s.tolist(), e.tolist(), strict=True)), dtype=X.U, count=len(s))
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(first, len(owner)))
    bits = np.empty((len(first), 64), dtype=np.int32)
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):  # one byte of each hash at a time
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(raw[:, k : k + 1], axis=1, bitorder="little"), first, axis=0, dtype=np.int32)
    over = np.packbits(2 * bits > counts[:, None], axis=1, bitorder="little")
    out[owner[first]] = over.view("<u8").ravel()
    return out, h, owner


def fingerprint_column(docs: DataFrame, name: str, text: str = "text", width: int = 3) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    schema = T.StructType([*docs.schema, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = X.flat(batch.column(batch.schema.get_field_index(text)))
            out = np.zeros(batch.num_rows, dtype=X.U)
            for a, b in X.pieces(offs):
                out[a:b] = fingerprints(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def distances(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the pivots, a row for each pivot."""
    return np.bitwise_count(fp[None, :] ^ _PIVOTS[:, None]).astype(np.int8)


def within(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) differ in at most so many bits: pivot by pivot what is too far goes, then the rest is verified."""
    alive = np.arange(len(i))
    for row in table:
        if not len(alive):
            break
        alive = alive[np.abs(row[i[alive]] - row[j[alive]]) <= most]
    ok = np.zeros(len(i), dtype=bool)
    ok[alive[np.bitwise_count(fp[i[alive]] ^ fp[j[alive]]) <= most]] = True
    return ok


def _pairs_in_groups(keys: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows with equal keys; rows are sorted by key."""
    table, left, right = distances(fp), [], []
    shift, at = 1, np.arange(len(keys))
    while len(at := at[at + shift < len(keys)]):
        at = at[keys[at] == keys[at + shift]]  # who has no neighbour at this distance has none further on
        ok = at[within(fp, table, at, at + shift, most)]
        left.append(ok)
        right.append(ok + shift)
        shift += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _flips(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in one large group: every change of up to so many of the bits in which its members differ is looked up."""
    order = np.argsort(fp)
    known, differ = fp[order], np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp)
    bits = [b for b in range(64) if int(differ) >> b & 1]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for chosen in chain.from_iterable(combinations(bits, k) for k in range(1, most + 1)):
        want = fp ^ X.U(sum(1 << b for b in chosen))
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        ok = np.flatnonzero((known[at] == want) & (fp < want))
        left.append(ok)
        right.append(order[at[ok]])
    return np.concatenate(left), np.concatenate(right)


def _all_groups(keys: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among rows with equal keys, however large a group is."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    few = np.flatnonzero(np.repeat(size <= MOST, size))
    i, j = _pairs_in_groups(keys[few], fp[few], most)
    yield fp[few[i]], fp[few[j]]
    for a, n in zip(first[size > MOST].tolist(), size[size > MOST].tolist(), strict=True):
        i, j = _flips(fp[a : a + n], most)
        yield fp[a + i], fp[a + j]


def _links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, X.U), np.empty(0, X.U)
        last = None
        for batch in _and_end(batches):
            if batch is not None:
                keys = np.concatenate((keys, batch.column(0).to_numpy().view(X.U)))
                fps = np.concatenate((fps, batch.column(1).to_numpy().view(X.U)))
                if not len(keys):
                    continue
                last = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))  # the last key may go on
            else:
                last = len(keys)
            k, f, keys, fps = keys[:last], fps[:last], keys[last:], fps[last:]
            if len(k):
                for a, b in _all_groups(k, f, most):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def block_pairs(fp: str, blocks: list[int], size: int):
    """Structs of a pair's number and the bits of its two blocks, for all pairs of blocks (given by their lowest bits)."""
    part = lambda b: F.shiftrightunsigned(F.col(fp), b).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    return F.array(*(F.xxhash64(F.lit(n), part(a), part(b)) for n, (a, b) in enumerate(combinations(blocks, 2))))


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """a, b: pairs of the distinct fingerprints (column fp) that differ in at most max_bits (0 to 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = [0, 16, 32, 48]
    rows = nodes.select("fp", F.posexplode(block_pairs("fp", blocks, 16)).alias("n", "key"))
    full = rows.groupBy("key").agg(F.count("*").alias("rows_of_key")).where(F.col("rows_of_key") > MOST)
    marked = written(rows.join(full, "key", "left"), "simhash-keys")
    few = marked.where("rows_of_key is null").select("key", "fp")
    # the four 8-bit blocks that key n leaves open: two 16-bit blocks, each cut in two
    cases = F.lit(None).cast("array<long>")
    for n, pair in enumerate(combinations(blocks, 2)):
        rest = [b + x for b in blocks if b not in pair for x in (0, 8)]
        cases = F.when(F.col("n") == n, block_pairs("fp", rest, 8)).otherwise(cases)
    many = marked.where("rows_of_key is not null").select("key", "fp", F.posexplode(cases).alias("m", "sub"))
    many = many.select(F.xxhash64("key", "m", "sub").alias("key"), "fp")
    return few.union(many).repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_links(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2, keep: list[str] | None = None) -> DataFrame:
    """docs (or only the columns to keep) with fingerprint (16 hex digits) and component_id, the smallest id that links lead to.

    Fingerprints are made once and written beside what is kept. A component's label is the struct of its smallest id and that row's
    fingerprint, so labels lead to ids without a join by label, of which one may have most rows.
    """
    keep = docs.columns if keep is None else keep
    fp, comp, shown, own = free(docs, "fp"), free(docs, "component_id"), free(docs, "fingerprint"), free(docs, "own_id")
    marked = fingerprint_column(docs, fp, text, width).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{doc_id}`").cast("long").alias(own), F.col(f"`{fp}`"))
    marked = written(marked, "fingerprints")
    nodes = written(marked.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(F.coalesce(F.col(f"`{own}`"), F.lit(_LAST))).alias("id")), "fingerprint-nodes")
    found = links(nodes.select("fp"), max_bits)
    for x in ("a", "b"):
        found = found.join(nodes.select(F.col("fp").alias(x), F.struct("id", "fp").alias(f"n{x}")), x)
    labels = components(found.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    of = nodes.join(labels, nodes["fp"] == labels["node.fp"], "left").select(F.col("fp").alias(f"{fp}_"), F.coalesce("label.id", "id").alias("component"))
    joined = marked.join(written(of, "fingerprint-components"), F.col(f"`{fp}`") == F.col(f"`{fp}_`"))
    return joined.select(*(F.col(f"`{c}`") for c in keep), F.lower(F.lpad(F.hex(f"`{fp}`"), 16, "0")).alias(shown), F.nullif(F.col("component"), F.lit(_LAST)).alias(comp))


BANDS, ROWS = 24, 5
_ODD = X.mix(np.arange(1, BANDS * ROWS + 1, dtype=X.U) * X.U(0xA24BAED4963EE407)) | X.U(1)
#: Bits in which fingerprints of sets of Jaccard similarity 0.8 and ``SMALL`` shingles or more differ at most: 9.7 in the mean, standard
#: deviation 2.9, so over it with a chance of about 1e-8; a repeated shingle counts once, as in the sets.
REACH, SMALL = 26, 160


def _signatures(buf: np.ndarray, offs: np.ndarray, width: int):
    """Per text: 16-byte digest of its normalised words, fingerprint and number of its distinct shingles, band keys. No words: None, 0, 0, none."""
    n = len(offs) - 1
    fp, count, bands = np.zeros(n, X.U), np.zeros(n, np.int64), np.zeros((n, BANDS), X.U)
    text, starts, ends, owner = normalised(buf, offs)
    if not len(starts):
        return [None] * n, fp, count, bands
    s, e, of = shingle_spans(starts, ends, owner, width)
    h = X.span_hashes(X.prefix_sums(np.frombuffer(text, np.uint8)), s, e)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    once = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))  # a passage that a text repeats must not outvote its other bits
    h, of = h[once], of[once]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    has = of[first]
    count[has] = np.diff(np.append(first, len(of)))
    raw, bits = h.astype("<u8").view(np.uint8).reshape(-1, 8), np.empty((len(first), 64), np.int32)
    for k in range(8):
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(raw[:, k : k + 1], axis=1, bitorder="little"), first, axis=0, dtype=np.int32)
    fp[has] = np.packbits(2 * bits > count[has, None], axis=1, bitorder="little").view("<u8").ravel()
    for b in range(BANDS):
        key = np.full(len(first), b, dtype=X.U)
        for odd in _ODD[b * ROWS : (b + 1) * ROWS]:
            key = X.mix(key ^ np.minimum.reduceat(h * odd, first))
        bands[has, b] = key
    return _text_keys(text, starts, ends, owner, n), fp, count, bands


def _text_keys(text: bytes, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> list[bytes | None]:
    """16-byte digests of so many texts' normalised words; None where there are none."""
    keys: list[bytes | None] = [None] * n
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        stop = np.append(first[1:], len(owner)) - 1
        for doc, a, z in zip(owner[first].tolist(), starts[first].tolist(), ends[stop].tolist(), strict=True):
            keys[doc] = xxhash.xxh128_digest(text[a:z])
    return keys


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = X.flat(batch.column(1))
            for a, b in X.pieces(offs):
                text, starts, ends, owner = normalised(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                s, e, of = shingle_spans(starts, ends, owner, width)
                h = X.span_hashes(X.prefix_sums(np.frombuffer(text, np.uint8)), s, e) if len(s) else np.empty(0, X.U)
                cut = np.searchsorted(of, np.arange(b - a + 1))
                sets = [np.unique(h[x:y]).view(np.int64) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["k", "shingles"])

    return run


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (k, shingles, private): k, numbers of shingles and of private ones, and how many of the others fall in each of 64 ranges."""
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            sizes = [batch.column(i).value_lengths().to_numpy().astype(np.int64) for i in (1, 2)]
            counts = []
            for i, n in zip((1, 2), sizes, strict=True):
                bucket = (batch.column(i).flatten().to_numpy().view(X.U) & X.U(63)).astype(np.int64) if int(n.sum()) else np.empty(0, np.int64)
                counts.append(np.bincount(np.repeat(np.arange(len(n)), n) * 64 + bucket, minlength=64 * len(n)))
            v = pa.FixedSizeListArray.from_arrays(pa.array((counts[0] - counts[1]).astype(np.int32)), 64).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes[0].astype(np.int32)), pa.array(sizes[1].astype(np.int32)), v], names=["k", "n", "r", "v"])


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with fingerprint and component_id, linked where the shingle sets' Jaccard similarity is at least so high.

    Texts with the same words are one node. Needs a similarity of 0.8 or more, for which the bands are made.
    """
    if similarity < 0.8:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    key = free(docs, "text_key")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = X.flat(batch.column(1))
            for a, b in X.pieces(offs):
                keys, f, n, bands = _signatures(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(f.view(np.int64)), pa.array(n), lists], names=schema.names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = X.flat(batch.column(batch.schema.get_field_index(text)))
            keys: list[bytes | None] = []
            for a, b in X.pieces(offs):
                keys += _text_keys(*normalised(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, key])

    signed = written(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(sign, schema), "signatures").where("k is not null")
    once = signed.groupBy("k").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # a node is its smallest id and its text's digest, in this order, so the smallest node of a component says its smallest id
    nodes = written(once.select(F.concat(_ordered_bytes(F.coalesce("id", F.lit(_LAST))), "k").alias("k"), "fp", "n", "bands"), "text-nodes")
    rows = nodes.select("k", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    members = written(rows.join(shared, ["band", "value"]), "band-members")
    wanted = written(members.select("k").distinct(), "band-nodes")
    texts = docs.mapInArrow(mark, T.StructType([*docs.schema, T.StructField(key, T.BinaryType())]))
    own = wanted.select(F.substring("k", 9, 16).alias("w_k"), _id_of(F.col("k")).alias("w_id"), "k")
    chosen = texts.select(F.col(f"`{key}`").alias("t_k"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("id"), F.col(f"`{text}`").alias("text"))
    chosen = chosen.join(own, (F.col("t_k") == F.col("w_k")) & (F.col("id") == F.col("w_id")))
    found = chosen.select("k", "text").mapInArrow(_shingle_sets(width), "k binary, shingles array<long>")
    sets = written(found.groupBy("k").agg(F.first("shingles").alias("shingles")).join(nodes.select("k", "fp"), "k"), "shingle-sets")

    # private shingles, which no other candidate has: they count against every pair of their text
    owners = sets.select(F.xxhash64("k").alias("o"), F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("o").alias("o")).where("c = 1")
    private = owners.groupBy("o").agg(F.collect_list("s").alias("private"))
    own_sets = sets.select("k", F.xxhash64("k").alias("o"), "shingles").join(private, "o", "left").select("k", "shingles", F.coalesce("private", F.array().cast("array<long>")).alias("private"))
    size = own_sets.mapInArrow(_histograms, "k binary, n int, r int, v array<int>")
    placed = written(members.join(size, "k"), "band-places")
    # the member with the fewest private shingles is what edited copies have in common; two others stand beside it
    reps = placed.groupBy("band", "value").agg(F.min("k").alias("r0"), F.max("k").alias("r1"), F.min_by("k", F.struct("r", "k")).alias("r2"))
    stars = placed.select("band", "value", "k").join(reps, ["band", "value"]).select(F.explode(F.array("r0", "r1", "r2")).alias("a"), F.col("k").alias("b"))
    edges = _verified(_ordered(stars), sets, similarity)
    parts = components(edges)
    label = lambda found: wanted.join(found, F.col("k") == F.col("node"), "left").select("k", F.coalesce("label", "k").alias("label"))
    # groups in which several components are left, without the members that are too unlike every member of another component to be worth a look
    labelled = placed.join(label(parts), "k")
    least = labelled.groupBy("band", "value", "label").agg(F.min("r").alias("r"), F.min("n").alias("n"))
    first = least.groupBy("band", "value").agg(F.min(F.struct("r", "label")).alias("a"), F.min("n").alias("n0"))
    second = least.join(first, ["band", "value"]).where("label != a.label").groupBy("band", "value").agg(F.min("r").alias("m1"))
    two = first.join(second, ["band", "value"]).select("band", "value", F.col("a.label").alias("l0"), F.col("a.r").alias("m0"), "m1", "n0")
    open_ = labelled.join(two, ["band", "value"])
    other_r = F.when(F.col("label") == F.col("l0"), F.col("m1")).otherwise(F.col("m0"))

    def able(n, r, n2, r2, common):
        """Whether two sets of these sizes and private shingles can be similar with at most so many in common: none of the private ones is."""
        return ((1 + similarity) * common + 1e-9 >= similarity * (n + n2)) & ((1 - similarity) * common + 1e-9 >= similarity * (r + r2))

    c = F.col
    some = open_.where(able(c("n"), c("r"), c("n0"), other_r, c("n") - c("r")))
    rest = written(some.select("band", "value", "k", "label", "n", "r", "v"), "open-groups")
    other = rest.select("band", "value", c("k").alias("k2"), c("label").alias("label2"), c("n").alias("n2"), c("r").alias("r2"), c("v").alias("v2"))
    # shingles that may be shared, by 64 ranges: no more are in common than the smaller number in each
    common = F.aggregate(F.zip_with("v", "v2", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    cheap = able(c("n"), c("r"), c("n2"), c("r2"), F.least(c("n") - c("r"), c("n2") - c("r2")))
    across = rest.join(other, ["band", "value"]).where((c("label") < c("label2")) & cheap & able(c("n"), c("r"), c("n2"), c("r2"), common))
    more = _verified(_ordered(across.select(F.col("k").alias("a"), F.col("k2").alias("b"))).join(_ordered(stars), ["a", "b"], "left_anti"), sets, similarity)
    of = label(components(edges.unionByName(more)))
    # nodes without any candidate are their own component
    found = nodes.select("k", "fp").join(of, "k", "left").withColumn("label", F.coalesce("label", "k"))
    final = written(found.select(F.substring("k", 9, 16).alias("own_key"), "fp", _id_of(F.col("label")).alias("component"), F.substring("label", 9, 16).alias("label")), "text-components")
    joined = texts.join(final, F.col(f"`{key}`") == final["own_key"], "left")
    shown, comp, group = free(docs, "fingerprint"), free(docs, "component_id"), free(docs, "component_key")
    return joined.select(
        *(texts[f"`{c}`"] for c in docs.columns),
        F.lower(F.lpad(F.hex(F.coalesce(final["fp"], F.lit(0))), 16, "0")).alias(shown),
        F.when(final["own_key"].isNull(), texts[f"`{doc_id}`"].cast("long")).otherwise(F.nullif(final["component"], F.lit(_LAST))).alias(comp),
        final["label"].alias(group),
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar: pivot distances first, then bits, then the sets.

    Sets of under ``SMALL`` shingles are cheap to compare, and their fingerprints say little: these go to the sets at once.
    """
    left = sets.select(F.col("k").alias("a"), F.col("fp").alias("fa"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("k").alias("b"), F.col("fp").alias("fb"), F.col("shingles").alias("sb"))
    prints = pairs.join(left.select("a", "fa", F.size("sa").alias("n")), "a").join(right.select("b", "fb"), "b")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= REACH
    for p in reversed(_PIVOTS.view(np.int64)[:4].tolist()):
        near = (F.abs(F.bit_count(F.col("fa").bitwiseXOR(F.lit(p))) - F.bit_count(F.col("fb").bitwiseXOR(F.lit(p)))) <= REACH) & near
    both = prints.where((F.col("n") < SMALL) | near).select("a", "b").join(left.drop("fa"), "a").join(right.drop("fb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    together = (F.size("sa") + F.size("sb")).cast("double")
    return written(both.select("a", "b", common.alias("c"), together.alias("t")).where(F.col("c") >= similarity * (F.col("t") - F.col("c")) - 1e-9).select("a", "b"), "similar")


def _ordered_bytes(number: Column) -> Column:
    """Eight bytes of a long that are ordered as the longs are."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def _id_of(node: Column) -> Column:
    """The long that a node begins with."""
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
