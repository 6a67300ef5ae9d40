"""Suffix-array dedup: the LCP-interval tree of shared substrings.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts in a document with a smaller
id. The method is an enhanced suffix array, built only where texts share something and cut into
parts that fit a task:

1. Each window of LENGTH bytes has an anchor, its ``GRAM``-byte string with the smallest hash (leftmost of
   equal ones); equal windows have equal anchors. Consecutive windows with one anchor form a segment of
   at most 2 * LENGTH - GRAM bytes; there is one for every 16 bytes of text. Blocks find out by ranges of hashes
   (see blocks) which anchors stand in more than one document.
2. Segments of such anchors go, once for each block and with the smallest id there, to the task that has
   the anchor's range. Equal segments are merged. Anchors with several different segments are the edges
   of shared passages: their segments' suffixes of LENGTH bytes or more are sorted, and a stack
   scan of the longest common prefixes gives the interval tree. An interval whose occurrences differ in
   the byte before (or have none) is a maximal repeat: a group of all its occurrences, with the smallest
   document among them, which covers the whole common prefix in all later documents.
3. Each block learns, for each segment sent, which of its windows also start in a smaller document.

A passage in every document costs one segment for each block. An anchor with ``HOT`` different segments or
more (the edge of a passage that many documents go on from differently) is not gathered: its windows
go one by one, spread by their own 128-bit hash with the smallest id, and come together only with
equals. So a task holds few segments of an anchor, whatever the corpus. Elsewhere hashes only choose
anchors and merge equal segments, whose bytes are then compared.

Defined results: null and empty texts have no bytes; a null id is larger than all others; equal ids
are one document, which removes nothing from itself; repeated rows get equal results; an empty table
gives an empty one. Cuts may fall inside a code point, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import textnum as X
from .columns import pick

LENGTH, GRAM = 50, 20
HOT = 2000
#: Windows that are sorted at once.
SORTED = 60_000
_LAST = np.iinfo(np.int64).max
_SLICE = 1 << 22
_NAME = X.U(0x5851F42D4C957F2D)


_ANCHOR = np.dtype([("h", "<u8"), ("kinds", "u1")])
_HEAD = np.dtype([("n", "u1"), ("place", "u1"), ("id", "<i8")])
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8")])


class Segments:
    """Segments of some texts: start (of the first window), n (windows), anchor (hash), place (of the anchor in it), hash, doc (row)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        for a in range(0, max(1, len(buf) - length + 1), _SLICE):
            part = buf[a : a + _SLICE + length - 1]
            for out, x in zip(found, _segments(part, np.clip(offs - a, 0, len(part)), length, gram), strict=True):
                out.append(x + a if out is found[0] else x)
        self.start, self.n, self.anchor, self.place, self.hash, self.doc = map(np.concatenate, found)


def _segments(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    none = np.empty(0, np.int64)
    width, n = length - gram + 1, len(buf) - length + 1
    if n <= 0:
        return none, none, none.astype(X.U), none, none.astype(X.U), none
    sums = X.prefix_sums(buf)
    at = np.arange(len(buf) - gram + 1)
    h = X.mix((sums[gram:] - sums[:-gram]) * X.powers(len(sums))[1][: len(at)])
    best = h & X.U(0xFFFFFFFFFF000000) | at.astype(X.U)  # the upper bits of the hash, then the place: leftmost of the smallest
    size = 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: n], best[width - size : width - size + n])
    anchor = (best[:n] & X.U(0xFFFFFF)).astype(np.int64)
    left = np.repeat(offs[1:], np.diff(offs))[:n] - np.arange(n)  # bytes that the text still has
    valid = left >= length
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return none, none, none.astype(X.U), none, none.astype(X.U), none
    breaks = np.append(np.flatnonzero(new | ~valid), n)
    n_windows = breaks[np.searchsorted(breaks, first, side="right")] - first
    place = anchor[first]
    doc = np.searchsorted(offs, first, side="right") - 1
    # anchors are the smallest hashes around them, so they are mixed once more to spread over all ranges
    return first, n_windows, X.mix(h[place] ^ _NAME), place - first, X.span_hashes(sums, first, first + n_windows + length - 1), doc


class Block:
    """A block's documents and segments."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table, self.length = table, length
        self.buf, self.offs = X.flat(table.column("text"))
        ids = table.column("doc_id").combine_chunks()
        self.order = ids.fill_null(_LAST).to_numpy()
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        for a, b in X.pieces(self.offs):
            lo = self.offs[a]
            s = Segments(self.buf[lo : self.offs[b]], self.offs[a : b + 1] - lo, length, gram)
            for out, x in zip(found, (s.start + lo, s.n, s.anchor, s.place, s.hash, s.doc + a), strict=True):
                out.append(x)
        self.start, self.n, self.anchor, self.place, self.hash, self.doc = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        self.id = self.order[self.doc.astype(np.int64)] if len(self.doc) else np.empty(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different anchors with their number of different segments (255: HOT or more), which of them stand in two documents of the block, and each segment's."""
        if not len(self.anchor):
            return np.empty(0, _ANCHOR), np.empty(0, bool), np.empty(0, np.int64)
        order = np.lexsort((self.hash, self.anchor))
        a, h, ids = self.anchor[order], self.hash[order], self.id[order]
        new = np.concatenate(([True], a[1:] != a[:-1]))
        first = np.flatnonzero(new)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        kinds = np.add.reduceat(new | np.concatenate(([True], h[1:] != h[:-1])), first)
        out = np.empty(len(first), _ANCHOR)
        out["h"], out["kinds"] = a[first], np.where(kinds >= HOT, 255, np.minimum(kinds, 254))
        return out, np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first), inverse

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of the chosen segments, sorted by anchor: a segment of each with the smallest id; and of each segment its entry or -1."""
        entry = np.full(len(self.anchor), -1)
        order = chosen[np.lexsort((self.id[chosen], self.hash[chosen], self.anchor[chosen]))]
        if not len(order):
            return order, entry
        a, h = self.anchor[order], self.hash[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))
        entry[order] = np.cumsum(new) - 1
        return order[new], entry

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different windows of the chosen segments as _WINDOW, sorted by hash; of each window its place, id and entry."""
        n = self.n[chosen]
        place, ids = np.repeat(self.start[chosen], n) + _ranges(n), np.repeat(self.id[chosen], n)
        found = np.empty(len(place), _WINDOW)
        found["id"] = ids
        for a in range(0, len(self.buf), _SLICE):  # hashes of bytes near each other, by slices
            mine = np.flatnonzero((place >= a) & (place < a + _SLICE))
            if len(mine):
                sums = X.prefix_sums(self.buf[a : a + _SLICE + self.length])
                p, half = place[mine] - a, self.length // 2
                found["h"][mine] = X.span_hashes(sums, p, p + self.length)
                found["g"][mine] = X.mix(X.span_hashes(sums, p, p + half) * X.U(0xC2B2AE3D27D4EB4F) + X.span_hashes(sums, p + half, p + self.length))
        one, entry = _smallest(found)
        return found[one], place, ids, entry


def _smallest(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with equal hashes the one with the smallest id, by hash; and each window's number among these."""
    order = np.lexsort((windows["id"], windows["g"], windows["h"]))
    if not len(order):
        return order, order
    h, g = windows["h"][order], windows["g"][order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def maximal_repeats(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, docs: np.ndarray, length: int):
    """Maximal repeats of at least so many bytes among strings buf[start:stop], each of a document.

    Gives the suffix array (string number, place in buf) and the groups (first, last, common prefix, smallest document)
    whose occurrences first..last of the suffix array don't all have the same byte before them.
    """
    n = np.maximum(0, stops - starts - length + 1)
    string = np.repeat(np.arange(len(starts)), n)
    place = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    if not len(place):
        return string, place, np.empty((0, 4), np.int64)
    room = stops[string] - place
    depth = -(-int(room.max()) // 8) * 8
    padded = np.concatenate((buf, np.zeros(depth, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[place]
    rows[np.arange(depth, dtype=np.int32) >= room.astype(np.int32)[:, None]] = 0
    keys = rows.view(">u8")
    order = np.lexsort((*(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)),))
    rows, string, place, room = rows[order], string[order], place[order], room[order]
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(axis=1), depth, same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(room[1:], room[:-1]))
    before = np.where(place > starts[string], buf[np.maximum(place - 1, 0)].astype(np.int64), -1 - np.arange(len(place)))
    return string, place, _scan(lcp, before, docs[string], length)


def _scan(lcp: np.ndarray, before: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """Stack scan: an interval closes where the common prefix gets shorter; a frame holds its prefix, first suffix, smallest document, and the byte before all of it (None: several)."""
    out: list[tuple[int, int, int, int]] = []
    inside = np.flatnonzero(lcp >= least)
    if not len(inside):
        return np.empty((0, 4), np.int64)
    cut = np.flatnonzero(np.diff(inside) > 1) + 1
    for run in np.split(inside, cut):
        a, z = int(run[0]), int(run[-1]) + 1
        left, own = before[a : z + 1].tolist(), docs[a : z + 1].tolist()
        stack: list[list] = []
        for i, common in enumerate([*lcp[a:z].tolist(), 0]):
            low, byte, first = own[i], left[i], i
            while stack and stack[-1][0] > common:
                top = stack.pop()
                low = min(low, top[2])
                byte = byte if byte == top[3] else None
                first = top[1]
                if byte is None:
                    out.append((a + first, a + i, top[0], low))
            if common >= least:
                if stack and stack[-1][0] == common:
                    top = stack[-1]
                    top[2] = min(top[2], low)
                    top[3] = top[3] if top[3] == byte else None
                else:
                    stack.append([common, first, low, byte])
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def _pack(heads: np.ndarray, text: np.ndarray, windows: np.ndarray) -> bytes:
    return len(heads).to_bytes(4, "little") + heads.tobytes() + len(text).to_bytes(4, "little") + text.tobytes() + windows.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at = 4 + n * _HEAD.itemsize
    size = int.from_bytes(blob[at : at + 4], "little")
    return np.frombuffer(blob, _HEAD, n, 4), np.frombuffer(blob, np.uint8, size, at + 4), np.frombuffer(blob, _WINDOW, offset=at + 4 + size)


def smaller_windows(heads: np.ndarray, text: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of each segment, a bit for each window that also starts in a document with a smaller id than the segment's."""
    if not len(heads):
        return np.empty(0, np.uint32)
    n = heads["n"].astype(np.int64)
    size = n + length - 1
    stop = np.cumsum(size)
    start, ids = stop - size, heads["id"].astype(np.int64)
    sums = X.prefix_sums(text)
    at = start + heads["place"]
    anchor, hash_ = X.mix(X.mix((sums[at + gram] - sums[at]) * X.powers(len(sums))[1][at]) ^ _NAME), X.span_hashes(sums, start, stop)
    order = np.lexsort((hash_, anchor))
    a, h = anchor[order], hash_[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[new]  # a segment of each kind
    if not np.array_equal(size[one][kind], size) or not np.array_equal(text[np.repeat(start[one][kind] - start, size) + np.arange(len(text))], text):
        raise ValueError("two segments have one hash")
    low = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    whole = ((np.uint64(1) << n.astype(X.U)) - np.uint64(1)).astype(np.uint32)
    mask = np.where(low[kind] < ids, whole, 0).astype(np.uint32)
    # anchors with several kinds of segments
    many = np.flatnonzero(np.concatenate(([False], anchor[one][1:] == anchor[one][:-1])) | np.concatenate((anchor[one][1:] == anchor[one][:-1], [False])))
    if len(many):
        seg = one[many]
        least = np.full(len(text) + 1, _LAST)  # by place of a window: smallest document of any group that covers it
        np.minimum.at(least, np.repeat(start[seg], n[seg]) + _ranges(n[seg]), np.repeat(low[many], n[seg]))
        # equal windows have equal anchors, so the suffix array can be cut between anchors
        total, new_anchor = np.cumsum(n[seg]), np.concatenate(([True], anchor[seg][1:] != anchor[seg][:-1]))
        cuts, done = [0], 0
        for i in np.flatnonzero(new_anchor)[1:].tolist():
            if total[i - 1] - done >= SORTED:
                cuts.append(i)
                done = total[i - 1]
        for x, y in zip(cuts, [*cuts[1:], len(seg)], strict=True):
            string, place, groups = maximal_repeats(text, start[seg[x:y]], stop[seg[x:y]], low[many[x:y]], length)
            for g in _chunks(groups, length):
                rows = g[:, 1] - g[:, 0] + 1
                which = np.repeat(g[:, 0], rows) + _ranges(rows)
                cover = np.repeat(g[:, 2], rows) - length + 1
                np.minimum.at(least, np.repeat(place[which], cover) + _ranges(cover), np.repeat(np.repeat(g[:, 3], rows), cover))
        among = np.full(len(one), -1)
        among[many] = np.arange(len(many))
        mine = np.flatnonzero(among[kind] >= 0)
        bit = _ranges(n[mine])
        found = least[np.repeat(start[one[kind[mine]]], n[mine]) + bit] < np.repeat(ids[mine], n[mine])
        mask[mine] = np.bitwise_or.reduceat(np.where(found, np.uint32(1) << bit.astype(np.uint32), np.uint32(0)), np.concatenate(([0], np.cumsum(n[mine])[:-1])))
    return mask


def _chunks(groups: np.ndarray, length: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Groups in runs that cover about so many windows with all their occurrences, or of one group."""
    total = np.cumsum((groups[:, 1] - groups[:, 0] + 1) * (groups[:, 2] - length + 1))
    a = 0
    while a < len(groups):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield groups[a:b]
        a = b


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (first and next byte of each removed run) and kept of each row."""
    if not gram <= length <= gram + 31:
        raise ValueError("a segment has 32 windows at most: length must be from gram to gram + 31")
    listed = B.make(pick(docs, doc_id=doc_id, text=text))
    parts = B.parts_for(listed, 2 << 20)

    def ask(name: str) -> Iterator[tuple[int, bytes]]:
        known, _, _ = Block(B.load(name), length, gram).anchors()
        cut = B.cut_by_part(known["h"], parts)
        return ((p, known[cut[p] : cut[p + 1]].tobytes()) for p in range(parts) if cut[p + 1] > cut[p])

    def anchors_of_all(blobs: list[bytes]) -> tuple[list[bytes], bytes]:
        """For each anchor two bits: whether it stands in two blocks, and whether it is hot."""
        each = [np.frombuffer(b, _ANCHOR) for b in blobs]
        all_, cut = np.concatenate(each), np.cumsum([0, *map(len, each)])
        _, inverse, counts = np.unique(all_["h"], return_inverse=True, return_counts=True)
        kinds = np.bincount(inverse, weights=np.where(all_["kinds"] == 255, HOT, all_["kinds"]))
        bits = np.stack((counts[inverse] > 1, kinds[inverse] >= HOT), axis=1)
        return [np.packbits(bits[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], b""

    def repeated(block: Block, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The segments of repeated anchors: of those that aren't hot, and of the hot ones."""
        known, here, inverse = block.anchors()
        cut, bits = B.cut_by_part(known["h"], parts), np.zeros((len(known), 2), dtype=bool)
        for p, blob in B.answers_of(name, "anchors").items():
            bits[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=2 * int(cut[p + 1] - cut[p])).reshape(-1, 2)
        again, hot = here | bits[:, 0], bits[:, 1]
        return np.flatnonzero((again & ~hot)[inverse]), np.flatnonzero((again & hot)[inverse])

    def send(name: str) -> Iterator[tuple[int, bytes]]:
        block = Block(B.load(name), length, gram)
        cold, hot = repeated(block, name)
        one, windows = block.entries(cold)[0], block.windows(hot)[0]
        cut, by_hash = B.cut_by_part(block.anchor[one].astype(X.U), parts), B.cut_by_part(windows["h"], parts)
        for p in range(parts):
            s, w = one[cut[p] : cut[p + 1]], windows[by_hash[p] : by_hash[p + 1]]
            if len(s) or len(w):
                heads, size = np.empty(len(s), _HEAD), block.n[s] + length - 1
                heads["n"], heads["place"], heads["id"] = block.n[s], block.place[s], block.id[s]
                yield p, _pack(heads, block.buf[np.repeat(block.start[s], size) + _ranges(size)], w)

    def judge(blobs: list[bytes]) -> tuple[list[bytes], bytes]:
        """For each blob the segments' masks, then a bit for each window that is not the smallest document's."""
        each = [_unpack(b) for b in blobs]
        mask = smaller_windows(np.concatenate([h for h, _, _ in each]), np.concatenate([t for _, t, _ in each]), length, gram)
        windows = np.concatenate([w for _, _, w in each])
        one, entry = _smallest(windows)
        later = windows["id"][one][entry] < windows["id"]
        a, b = np.cumsum([0, *(len(h) for h, _, _ in each)]), np.cumsum([0, *(len(w) for _, _, w in each)])
        return [mask[a[i] : a[i + 1]].astype("<u4").tobytes() + np.packbits(later[b[i] : b[i + 1]]).tobytes() for i in range(len(each))], b""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _removed(name)

    def _starts(block: Block, name: str) -> np.ndarray:
        """Where the windows begin that also start in a smaller document."""
        cold, hot = repeated(block, name)
        one, entry = block.entries(cold)
        windows, place, ids, which = block.windows(hot)
        cut, by_hash = B.cut_by_part(block.anchor[one].astype(X.U), parts), B.cut_by_part(windows["h"], parts)
        masks, later = np.zeros(len(one), np.uint32), np.zeros(len(windows), dtype=bool)
        for p, blob in B.answers_of(name, "windows").items():
            n = int(cut[p + 1] - cut[p])
            masks[cut[p] : cut[p + 1]] = np.frombuffer(blob, "<u4", n)
            later[by_hash[p] : by_hash[p + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 * n), count=int(by_hash[p + 1] - by_hash[p]))
        found = place[later[which] | (windows["id"][which] < ids)] if len(which) else place
        if not len(cold):
            return found
        mask = np.where(block.id[one][entry[cold]] < block.id[cold], np.uint32(0xFFFFFFFF), masks[entry[cold]])
        bit = _ranges(block.n[cold])
        flagged = (np.repeat(mask, block.n[cold]) >> bit.astype(np.uint32) & np.uint32(1)).astype(bool)
        return np.concatenate((found, (np.repeat(block.start[cold], block.n[cold]) + bit)[flagged]))

    def _removed(name: str) -> Iterator[pa.RecordBatch]:
        block = Block(B.load(name), length, gram)
        at, gone = _starts(block, name), np.zeros(len(block.buf), dtype=bool)
        for a in range(0, len(block.buf), 1 << 20):  # windows that start here, by slices of memory
            mine = at[(at >= a) & (at < a + (1 << 20))]
            if len(mine):
                stop = min(len(block.buf), a + (1 << 20) + length)
                gone[a:stop] |= X.covered(mine - a, length, stop - a)
        offs = block.offs
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads_ = offs[:-1][offs[:-1] < len(gone)]
        begins[heads_] = gone[heads_]
        n_removed, n_spans = X.per_value(gone, offs), X.per_value(begins, offs)
        for a, b in X.pieces(offs):
            kept, spans = [], []
            for i in range(a, b):
                own = block.buf[offs[i] : offs[i + 1]]
                if n_removed[i]:
                    g = gone[offs[i] : offs[i + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                    spans.append([{"start": x, "stop": y} for x, y in edge.reshape(-1, 2).tolist()])
                    own = own[~g]
                else:
                    spans.append([])
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [block.table.column("doc_id").combine_chunks().slice(a, b - a), pa.array(np.diff(offs[a : b + 1])), pa.array(n_removed[a:b]), pa.array(n_spans[a:b]), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    with_anchors = B.stored(B.answered(B.sent(listed, ask), anchors_of_all), listed, "anchors")
    ready = B.stored(B.answered(B.sent(with_anchors, send), judge), with_anchors, "windows")
    return B.spread(ready.select("block")).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary")
