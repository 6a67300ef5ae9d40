"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end. P(token | context) is a product
along a path of at most three softmaxes of ``WIDTH`` outcomes, all trained alike:

1. the end, the five most frequent words, or one of ten groups of words by their last two bytes;
2. in a group, its six next most frequent words, or one of ten cells by the words' first two bytes;
3. in a cell, its fifteen next most frequent words, or the rest.

Each softmax has weights of hashed context features (``ROWS`` rows a level): the last word, the last two together,
the word before the last (a skip), the last three classes and the second and fourth last ones; below the first level
fewer of them, hashed with the node. A word of a cell's rest then has the closed form (c + 1/2) / (N + (V + 1) / 2) over that rest,
the extra half for all unseen tokens, which is what a softmax of the words' own weights has as its optimum.

What grows with the corpus: exact counts of all words, and for each pair of last words that the training texts
continue alike twice, the code (the highest ``TELL`` bits of the hash) of what continues it most often (of equally
frequent ones the smallest). The most frequent word of that code is the expected word, one word and no other. It is a feature of
all softmaxes that its path passes: a weight for the outcome that leads to it, by level and by how often and how surely
the pair was continued so and whether the last expectation held; in a cell's rest the same feature tells the expected word from
all others, which share what it leaves by their closed form. These weights are trained with the others, each
training token held against the counts without itself. Every factor sums to one, and so does the product over all
words and the unseen ones: this is one distribution.

Reproducible: rows go to blocks by the hash of id and text, in the order of that hash, and how many blocks and
ranges there are follows from the bytes of all texts; so blocks, rounds (block modulo ``ROUNDS``), AdaGrad steps within a
block and the order in which changes are added are functions of the table alone, however it is partitioned.
What differs between runs is rounding in the last digits at most.

Training: ``ROUNDS`` rounds, each over its own share of the blocks. A block begins with the round's weights, takes
AdaGrad steps and sends its changes by ranges of rows; these are averaged by how many tokens touched a row, in groups
of ``FAN`` and again until one is left, and the weights (a fixed 6 MB) are broadcast for the next
round. Scoring takes blocks in batches of numpy arrays. Words are cut and hashed once, and blocks
hold word numbers.

Defined results: null and empty texts are an end; null ids are training rows; repeated rows count each;
an empty table gives an empty one; without any training row all probabilities are those of counts 0. A text may be
of any length: it is cut at white space for hashing, and contexts go on over the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textnum as X
from .columns import pick
from .shared import lean, removed, scratch, written

WIDTH, ROWS, LEVELS, ROUNDS = 16, 1 << 15, 3, 3
FREQUENT, GROUPS = (5, 6, 15), 10
BATCH, RATE, SLICE = 4096, 0.07, 1 << 16
#: Features of the context on each level.
FEATURES = (5, 3, 2)
#: Blocks at least, bytes of text of one, and bytes of text whose hashes make a range.
LEAST, BLOCK, RANGE, FAN = 12, 8 << 20, 16 << 20, 64
#: Most frequent words among which the tree's own words are found.
CANDIDATES = 4096
END, START = X.U(0x1D8E4E27C47D124F), X.U(0xEB382D69B1F1E2A5)
_STEP = X.U(0x9E3779B97F4A7C15)
_ONES = np.ones(WIDTH, np.float32)
#: Share of a full step that the expectations' weights take in a batch.
LEAN = 0.5
#: States of the expectation: 8 of how often, 4 of how surely, 3 of the one before.
STATES = 96


def _cells(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group times ten and cell of words, by their last and first two bytes."""
    two = ends - starts > 1
    last = low[ends - 1].astype(X.U) * X.U(256) + np.where(two, low[ends - 2], 0).astype(X.U)
    first = low[starts].astype(X.U) * X.U(256) + np.where(two, low[np.minimum(starts + 1, len(low) - 1)], 0).astype(X.U)
    return (X.mix(last + X.U(7)) % X.U(GROUPS) * X.U(GROUPS) + X.mix(first + X.U(70_001)) % X.U(GROUPS)).astype(np.uint8)


def _cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """offs, and more of them at white space in values longer than a piece."""
    more = []
    for i in np.flatnonzero(np.diff(offs) > X.PIECE).tolist():
        at = int(offs[i])
        while offs[i + 1] - at > X.PIECE:
            blank = np.flatnonzero(X.SPACE[buf[at + X.PIECE : min(at + X.PIECE + (1 << 20), int(offs[i + 1]))]])
            if not len(blank):  # a word that goes on for a million bytes: the rest is one piece
                break
            at += X.PIECE + int(blank[0])
            more.append(at)
    return np.sort(np.concatenate((offs, np.array(more, offs.dtype)))) if more else offs


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, cell and row number of each token of a column, an end after each row's words."""
    buf, offs = X.flat(column)
    cut = _cuts(buf, offs)
    out: list[list[np.ndarray]] = [[], [], []]
    for a, b in X.pieces(cut):
        low, o = X.LOWER[buf[cut[a] : cut[b]]], cut[a : b + 1] - cut[a]
        starts, ends, owner = X.spans(low, o, X.NOT_SPACE)
        out[0].append(X.span_hashes(X.prefix_sums(low), starts, ends))
        out[1].append(_cells(low, starts, ends))
        out[2].append(np.searchsorted(offs, cut[a + owner], side="right") - 1)
    h, k, owner = (np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (X.U, np.uint8, np.int64), strict=True))
    at = np.searchsorted(owner, np.arange(len(offs) - 1), side="right")
    return np.insert(h, at, END), np.insert(k, at, 0), np.insert(owner, at, np.arange(len(offs) - 1))


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, where one of each stands, and each one's number."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(h), np.uint32)
    inverse[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return s[new], order[new], inverse


def before(x: np.ndarray, owner: np.ndarray, n: int, none) -> np.ndarray:
    """What stood n places before in the same row."""
    out = np.full(len(x), none, x.dtype)
    if len(x) > n:
        same = owner[n:] == owner[:-n]
        out[n:][same] = x[:-n][same]
    return out


#: Bits of a word's hash that tell continuations of one context apart: its code.
TELL = 16


def context_bits(parts: int) -> int:
    """Bits of a context's hash: 32 more than it takes to tell the ranges apart, so that as many contexts share one at any size."""
    return min(32 + max(1, (parts - 1).bit_length()), 64 - TELL)


def context_keys(h: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest so many bits of the hash of the two words before each token, the others 0; and which tokens have two."""
    w1, w2 = before(h, owner, 1, START), before(h, owner, 2, START)
    return X.mix(X.mix(w1 + X.U(11)) ^ w2) >> X.U(64 - bits) << X.U(64 - bits), w2 != START


def short(h: np.ndarray, bits: int) -> np.ndarray:
    """A word's code in the place behind a context's bits."""
    return h >> X.U(64 - TELL) << X.U(64 - bits - TELL)


# ---- blocks


def _file(path: str, block: int) -> str:
    return f"{path}/{block:012d}"


def load(path: str, block: int):
    """Rows' ids and held_out, tokens of each row, the block's words in order with their cells, and number of each token's word."""
    table, words = B.load(_file(path, block)), B.load(_file(path, block) + ".words")
    lists = table.column("tokens").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    n = lists.value_lengths().to_numpy().astype(np.int64)
    return table.select(["doc_id", "held_out"]), n, words.column("h").to_numpy(), words.column("k").to_numpy(), lists.flatten().to_numpy()


def _ask(h: np.ndarray, known: np.ndarray, k: np.ndarray, inverse: np.ndarray, training: np.ndarray, owner: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """By ranges: the words with their training counts; from ``parts`` on, training contexts with continuations and counts, and other contexts."""
    bits = context_bits(parts)
    counts = np.bincount(inverse, weights=training, minlength=len(known)).astype("<u4")
    cut = B.cut_by_part(known, parts)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[p], cut[p + 1])
        yield p, np.array([cut[p + 1] - cut[p]], "<u4").tobytes() + _steps(known[s]) + _planes(counts[s]) + k[s].tobytes()
    keys, has = context_keys(h, owner, bits)
    s = np.sort((keys | short(h, bits))[has & training])
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    pairs, counts = s[first], np.diff(np.append(first, len(s)))
    once, often, other = pairs[counts == 1], pairs[counts > 1], np.sort(keys[has & ~training])
    other = other[np.concatenate(([True], other[1:] != other[:-1]))] if len(other) else other
    counts = counts[counts > 1].astype("<u4")
    cuts = [B.cut_by_part(x, parts) for x in (once, often, other)]
    for p in range(parts):
        at = [x[p : p + 2].tolist() for x in cuts]
        if any(i < j for i, j in at):
            lists = b"".join(_steps(x[i:j] >> X.U(64 - bits - TELL)) for x, (i, j) in zip((once, often, other), at, strict=True))
            yield parts + p, np.array([j - i for i, j in at], "<u4").tobytes() + lists + _planes(counts[at[1][0] : at[1][1]])


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, highest bytes first: where these are all 0, a shuffle's compression takes them away."""
    return x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(view: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    """n numbers of a kind, and where they end."""
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(view[at : at + n * size], np.uint8).reshape(size, n).T).view(np.dtype(kind).newbyteorder(">")).ravel()
    return x.astype(kind), at + n * size


def _steps(x: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return _planes(np.diff(x, prepend=X.U(0)))


def _unsteps(view: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    x, at = _unplanes(view, at, n, "u8")
    return np.cumsum(x, dtype=X.U), at


def _count_words(blobs: list[bytes]) -> tuple[list[bytes], pa.Table]:
    """Each block's counts in the order of its entries; sums by cell; the most frequent words."""
    each: list[list[np.ndarray]] = [[], [], []]
    for b in blobs:
        view = memoryview(b)
        n = int(np.frombuffer(view[:4], "<u4")[0])
        h, at = _unsteps(view, 4, n)
        c, at = _unplanes(view, at, n, "u4")
        for x, y in zip(each, (h, c, np.frombuffer(view[at:], np.uint8)), strict=True):
            x.append(y)
    h, c, k = map(np.concatenate, each)
    known, at, inverse = numbered(h)
    c = np.bincount(inverse, weights=c).astype(np.int64)
    k, word, seen = k[at], known != END, c > 0
    cells = GROUPS * GROUPS
    n, v = np.bincount(k, weights=c * word, minlength=cells), np.bincount(k[seen & word], minlength=cells)
    words = np.flatnonzero(word & seen)
    if len(words) > CANDIDATES:
        words = words[c[words] >= np.partition(c[words], -CANDIDATES)[-CANDIDATES]]
    words = words[np.lexsort((known[words], -c[words]))[:CANDIDATES]]
    cut = np.cumsum([0, *map(len, each[0])]).tolist()
    replies = [_planes(c[inverse[a:b]].astype(X.U)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    end, cell = np.flatnonzero(~word), np.flatnonzero(v)
    # the most frequent word of each code, of equally frequent ones the smallest; one that was seen once is never expected
    told = np.flatnonzero(word & (c > 1))
    told = told[np.lexsort((known[told], -c[told], known[told] >> X.U(64 - TELL)))]
    code = known[told] >> X.U(64 - TELL)
    told = told[np.concatenate(([True], code[1:] != code[:-1]))] if len(told) else told
    more = {
        "kind": np.repeat([-1, -2, 0, 1], [len(cell), len(end), len(words), len(told)]).astype(np.int32),
        "h": np.concatenate((cell * 0, end * 0, known[words].view(np.int64), known[told].view(np.int64))),
        "c": np.concatenate((n[cell].astype(np.int64), c[end], c[words], c[told])),
        "v": np.concatenate((v[cell], seen[end], words * 0 + 1, told * 0 + 1)).astype(np.int64),
        "k": np.concatenate((cell, end * 0, k[words], k[told])).astype(np.int32),
    }
    return replies, pa.table(more)


def _continue(blobs: list[bytes], bits: int) -> list[bytes]:
    """For each block the contexts it knows whose most frequent continuation was seen twice: context with the word's bits, that count, the context's count."""
    keys, counts, asked = [], [], []
    for b in blobs:
        view = memoryview(b)
        sizes = np.frombuffer(view[:12], "<u4").tolist()
        at, lists = 12, []
        for n in sizes:
            x, at = _unsteps(view, at, n)
            lists.append(x << X.U(64 - bits - TELL))
        keys += lists[:2]
        counts += [np.ones(sizes[0], np.int64), _unplanes(view, at, sizes[1], "u4")[0].astype(np.int64)]
        asked.append(lists)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    k, c = k[first], np.add.reduceat(c, first) if len(first) else c
    tell = X.U(64 - bits)
    x = k >> tell
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else first
    total, most = (np.add.reduceat(c, head), np.maximum.reduceat(c, head)) if len(head) else (c, c)
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(x))))
    hits = np.flatnonzero(c == most[of])
    best = hits[np.concatenate(([True], of[hits][1:] != of[hits][:-1]))] if len(hits) else hits
    ok = most >= 2
    x, best, most, total = x[head][ok], k[best][ok], most[ok], total[ok]
    out = []
    for parts in asked:
        mine = np.zeros(len(x) + 1, bool)
        for p in parts:
            want = p >> tell
            at = np.searchsorted(x, want)
            at[at < len(x)] = np.where(x[at[at < len(x)]] == want[at < len(x)], at[at < len(x)], len(x))
            mine[at] = True
        i = np.flatnonzero(mine[:-1])
        out.append(best[i].astype("<u8").tobytes() + np.minimum(most[i], 65535).astype("<u2").tobytes() + np.minimum(total[i], 65535).astype("<u2").tobytes())
    return out


class Words:
    """What is known of the whole corpus: sums, the tree's own words (at most five, sixty and fifteen hundred), and a word for each code."""

    def __init__(self, cells: list[tuple[int, int, int]], end: tuple[int, int], frequent: list[tuple[int, int, int]], told: list[tuple[int, int, int]] = ()):
        """cells: (cell, tokens, words); end: (count, 1 if seen); frequent: (hash, count, cell), most frequent first; told: such words, one for a code at most."""
        n, v = np.zeros((GROUPS, GROUPS)), np.zeros((GROUPS, GROUPS))
        for cell, tokens_, words in cells:
            n[divmod(cell, GROUPS)] += tokens_
            v[divmod(cell, GROUPS)] += words
        self.n, self.v = int(n.sum()) + end[0], int(v.sum()) + end[1]
        mass = [np.zeros(WIDTH), np.zeros((GROUPS, WIDTH)), np.zeros((GROUPS, GROUPS, WIDTH))]
        mass[0][0] = end[0]
        paths: dict[int, tuple[int, int, int]] = {int(END): (0, 0, 0)}
        used = [0, [0] * GROUPS, [[0] * GROUPS for _ in range(GROUPS)]]
        for h, c, cell in frequent:
            g, s = divmod(cell, GROUPS)
            if used[0] < FREQUENT[0]:
                used[0] += 1
                path = (used[0], 0, 0)
                mass[0][used[0]] += c
            elif used[1][g] < FREQUENT[1]:
                path = (1 + FREQUENT[0] + g, used[1][g], 0)
                mass[1][g][used[1][g]] += c
                used[1][g] += 1
            elif used[2][g][s] < FREQUENT[2]:
                path = (1 + FREQUENT[0] + g, FREQUENT[1] + s, used[2][g][s])
                mass[2][g][s][used[2][g][s]] += c
                used[2][g][s] += 1
            else:
                continue
            n[g, s] -= c
            v[g, s] -= 1
            paths[h] = path
        mass[2][:, :, WIDTH - 1] = n
        mass[1][:, FREQUENT[1] :] = mass[2].sum(axis=2)
        mass[0][1 + FREQUENT[0] :] = mass[1].sum(axis=1)
        self.rest_n, self.rest_v = n.ravel(), v.ravel()
        log = lambda m: np.log((m + 0.5) / (m + 0.5).sum(axis=-1, keepdims=True)).astype(np.float32)
        self.bias = [log(m).reshape(-1, WIDTH) for m in mass]
        self.own = np.array(sorted(paths), X.U)
        self.paths = np.array([paths[h] for h in sorted(paths)], np.uint8)
        self.told_word, told_cell, told_count = np.zeros(1 << TELL, X.U), np.zeros(1 << TELL, np.uint8), np.zeros(1 << TELL)
        if told:
            h, c, k = (np.array(x, t) for x, t in zip(zip(*told, strict=True), (X.U, np.float64, np.uint8), strict=True))
            code = (h >> X.U(64 - TELL)).astype(np.int64)
            self.told_word[code], told_count[code], told_cell[code] = h, c, k
        # the end is a word of the tree, and expected where its own code is
        self.told_word[int(END) >> (64 - TELL)] = END
        self.told_path = self.path(self.told_word, told_cell)
        self.told_nodes = nodes(self.told_path)
        in_rest = (self.told_word > 0) & (self.told_path[:, 2] == WIDTH - 1) & (self.told_nodes[2] >= 0)
        #: log of what all others of the rest have without it
        self.told_others = np.zeros(1 << TELL)
        self.told_others[in_rest] = np.log1p(-np.exp(self.in_rest(told_count[in_rest], told_cell[in_rest])))

    def path(self, known: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The outcomes on the three levels for each word (0 below its last one), a column for each level."""
        g, s = np.divmod(k, np.uint8(GROUPS))
        out = np.stack((1 + FREQUENT[0] + g, FREQUENT[1] + s, np.full(len(k), WIDTH - 1)), axis=1).astype(np.uint8)
        at = np.minimum(np.searchsorted(self.own, known), len(self.own) - 1)
        own = self.own[at] == known
        out[own] = self.paths[at[own]]
        return out

    def in_rest(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log P(word | rest of its cell)."""
        return np.log((c + 0.5) / (self.rest_n[k] + 0.5 * (self.rest_v[k] + 1)))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def classes(path: np.ndarray) -> np.ndarray:
    """Class of each word, for the features: its outcome on the first level, or on the second of its group."""
    d1, d2 = path[:, 0], path[:, 1]
    return np.where(d1 > FREQUENT[0], 1 + FREQUENT[0] + (d1 - 1 - FREQUENT[0]) * WIDTH + d2, d1).astype(np.uint8)


def nodes(path: np.ndarray) -> list[np.ndarray]:
    """Number of the softmax on each level that a word's path passes, -1 where it has ended."""
    g = path[:, 0].astype(np.int32) - 1 - FREQUENT[0]
    s = path[:, 1].astype(np.int32) - FREQUENT[1]
    return [np.zeros(len(path), np.int32), np.where(g >= 0, g, -1), np.where((g >= 0) & (s >= 0), g * GROUPS + s, -1)]


def features(h: np.ndarray, c: np.ndarray, owner: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
    """For each level the rows of the weights that each token's context has (any where the path has ended)."""
    w1, w2 = before(h, owner, 1, START), before(h, owner, 2, START)
    c1, c2, c3, c4 = (before(c, owner, n, 255).astype(X.U) for n in (1, 2, 3, 4))
    both = X.mix(w1 + X.U(1)) ^ w2
    names = ((w1, both, w2 * X.U(3), c1 + c2 * X.U(256) + c3 * X.U(65536), c2 + c4 * X.U(256)), (w1, both, c1 + c2 * X.U(256)), (w1, w2 * X.U(3)))
    out = []
    for level, (each, node) in enumerate(zip(names, at, strict=True)):
        base = node.astype(np.int64).view(X.U) * X.U(0xC2B2AE3D27D4EB4F)
        out.append(np.stack([(X.mix(x + base + X.U(int(_STEP) * (8 * level + i + 1) % (1 << 64))) >> X.U(64 - 15)).astype(np.uint16) for i, x in enumerate(each)], axis=1))
    return out


def _sums(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each context's weights by outcome, held between -60 and 60 so that none of their exponentials is lost."""
    x = weights.take(rows[:, 0], axis=0, mode="clip")  # all rows are there: this only spares their check
    for i in range(1, rows.shape[1]):
        x += weights.take(rows[:, i], axis=0, mode="clip")
    x += bias
    return np.clip(x, -60, 60, out=x)


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = _sums(weights, bias, rows)
    return x - np.log(np.exp(x) @ _ONES)[:, None]


class Expected:
    """The expected words of some tokens' contexts, level by level: their state where the token's own path passes a softmax that the expected word's passes too (else -1), and the outcome there."""

    def __init__(self, words: Words, path: np.ndarray, at: list[np.ndarray], state: np.ndarray, hit: np.ndarray, code: np.ndarray):
        self.hit, self.code = hit, code
        i = np.flatnonzero(state >= 0)
        state, code = state[i].astype(np.int8), code[i]
        self.toward = np.zeros(path.shape, np.uint8)
        self.toward[i] = words.told_path[code]
        self.state = []
        for level in range(LEVELS + 1):
            if level < LEVELS:
                mine = at[level][i]
                ok = (mine >= 0) & (words.told_nodes[level][code] == mine)
            else:
                ok = ok & (path[i, 2] == WIDTH - 1) & (self.toward[i, 2] == WIDTH - 1)
            held = np.full(len(path), -1, np.int8)
            held[i[ok]] = state[ok]
            self.state.append(held)

    def add(self, x: np.ndarray, level: int, i: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds the weights to the sums x of the tokens i; which of them have an expectation here, its state and outcome."""
        state = self.state[level][i]
        j = np.flatnonzero(state >= 0)
        state, toward = state[j], self.toward[i[j], level]
        x[j, toward] = np.clip(x[j, toward] + lead[level][state], -60, 60)
        return j, state, toward


class Block:
    """A block with what the whole corpus says of its words and contexts, in slices of tokens."""

    def __init__(self, path: str, block: int, words: Words, parts: int, expecting: bool = True):
        self.expecting = expecting
        self.table, n, self.known, self.k, self.inverse = load(path, block)
        answers = B.answers_of(_file(path, block), "counts")
        self.bits = context_bits(parts)
        self.count = np.concatenate([_unplanes(memoryview(answers[p]), 0, len(answers[p]) // 8, "u8")[0] for p in sorted(answers) if p < parts]).astype(np.int64)
        self.expected, self.often, self.total = np.empty(0, X.U), np.empty(0, np.int64), np.empty(0, np.int64)
        if said := [answers[p] for p in sorted(answers) if p >= parts]:
            cut = [len(b) // 12 for b in said]
            self.expected = np.concatenate([np.frombuffer(b, "<u8", m) for b, m in zip(said, cut, strict=True)])
            self.often = np.concatenate([np.frombuffer(b, "<u2", m, 8 * m) for b, m in zip(said, cut, strict=True)]).astype(np.int64)
            self.total = np.concatenate([np.frombuffer(b, "<u2", m, 10 * m) for b, m in zip(said, cut, strict=True)]).astype(np.int64)
        self.held = self.table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.words, self.path = words, words.path(self.known, self.k)
        self.classes = classes(self.path)

    def slices(self, own: np.ndarray) -> Iterator[tuple]:
        """Slices of tokens: word numbers, paths, nodes, rows of the weights, expectations, row numbers."""
        state, hit, code = self.expectations(own)
        for a in range(0, len(self.inverse), SLICE):
            lead = min(a, 4)
            s = slice(a - lead, a + SLICE)
            number, owner = self.inverse[s], self.owner[s]
            path = self.path[number]
            at = nodes(path)
            rows = features(self.known[number], self.classes[number], owner, at)
            path, at, told = path[lead:], [x[lead:] for x in at], slice(a, a + SLICE)
            yield number[lead:], path, at, [x[lead:] for x in rows], Expected(self.words, path, at, state[told], hit[told], code[told]), owner[lead:]

    def expectations(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State of each token's expectation (-1: none), whether it holds, and the code; tokens of training rows (own) are held against the counts without themselves."""
        if not len(self.expected) or not self.expecting:
            return np.full(len(self.inverse), -1), np.zeros(len(self.inverse), bool), np.zeros(len(self.inverse), np.int64)
        h = self.known[self.inverse]
        keys, has = context_keys(h, self.owner, self.bits)
        x = self.expected >> X.U(64 - self.bits) << X.U(64 - self.bits)
        at = np.minimum(np.searchsorted(x, keys), len(x) - 1)
        i = np.flatnonzero(has & (x[at] == keys))
        at, h, own = at[i], h[i], own[i]
        code = (self.expected[at] << X.U(self.bits) >> X.U(64 - TELL)).astype(np.int64)
        # the token's own part in that count
        less = own & (code == (h >> X.U(64 - TELL)).astype(np.int64))
        word = self.words.told_word[code]
        n, total = self.often[at] - less, np.maximum(self.total[at] - own, 1)
        ok = (word > 0) & (n > 0)
        i, n, total, code, right = i[ok], n[ok], total[ok], code[ok], word[ok] == h[ok]
        held, hit, codes = np.full(len(self.inverse), -1), np.zeros(len(self.inverse), bool), np.zeros(len(self.inverse), np.int64)
        now = np.zeros(len(self.inverse), np.int8)
        now[i] = 1 + right
        last = before(now, self.owner, 1, 0)[i]
        many = np.minimum(np.log2(n).astype(np.int64), 7)
        sure = np.minimum(4 * n // total, 3)
        held[i], hit[i], codes[i] = (many * 4 + sure) * 3 + last, right, code
        return held, hit, codes

    def score(self, weights: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Natural log P of each token."""
        out = [np.empty(0)]
        for number, path, at, rows, told, _ in self.slices(np.zeros(len(self.inverse), bool)):
            out.append(log_chance(weights, lead, self.words, path, at, rows, told, self.count[number], self.k[number]))
        return np.concatenate(out)


def log_chance(weights: np.ndarray, lead: np.ndarray, words: Words, path: np.ndarray, at: list[np.ndarray], rows: list[np.ndarray], told: Expected, count: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Natural log P of words, given by path, count and cell, each in its context, given by rows and told."""
    log = np.zeros(len(path))
    for level in range(LEVELS):
        i = np.flatnonzero(at[level] >= 0)
        x = _sums(weights[level], words.bias[level][at[level][i]], rows[level][i])
        told.add(x, level, i, lead)
        own = x.ravel().take(np.arange(0, x.size, WIDTH) + path[i, level])
        log[i] += own - np.log(np.exp(x, out=x) @ _ONES)
    rest = np.flatnonzero((at[2] >= 0) & (path[:, 2] == WIDTH - 1))
    log[rest] += words.in_rest(count[rest], k[rest])
    i = np.flatnonzero(told.state[LEVELS] >= 0)
    x = lead[LEVELS][told.state[LEVELS][i]]
    # told from the others of the rest, or one of these by its share of what they have
    log[i] = np.where(told.hit[i], log[i] - words.in_rest(count[i], k[i]) - np.logaddexp(0, -x), log[i] - words.told_others[told.code[i]] - np.logaddexp(0, x))
    return log


def first_lead() -> np.ndarray:
    """Weights of expectations before training, by level (the last: in a cell's rest) and state: how surely, and on the tree's levels as much more as an outcome among others needs."""
    sure = (np.arange(STATES) // 3 % 4 + 0.5) / 4
    return np.log(sure / (1 - sure)) + np.array([2.0, 2.0, 2.0, 0.0])[:, None]


class Trainer:
    """A block's own weights, moved by AdaGrad with a rate for each row; those of expectations, which all tokens share, by the curvature of each batch."""

    def __init__(self, weights: np.ndarray, lead: np.ndarray, bias: list[np.ndarray]):
        self.weights, self.bias, self.begin = weights.copy(), bias, weights
        self.lead, self.lead_begin, self.tried = lead.copy(), lead, np.zeros(lead.shape)
        self.squares = np.full(weights.shape[:2], 1e-3, np.float32)
        self.touched = np.zeros(weights.shape[:2], np.int64)

    def learn(self, level: int, rows: np.ndarray, node: np.ndarray, y: np.ndarray, told: Expected | None = None, i: np.ndarray | None = None) -> None:
        weights, squares, wide = self.weights[level], self.squares[level], rows.shape[1]
        g = _sums(weights, self.bias[level][node], rows)
        if told:
            j, state, toward = told.add(g, level, i, self.lead)
        np.exp(g, out=g)
        g *= (-1 / (g @ _ONES))[:, None]
        if told:
            self.lean(level, state, -g[j, toward], y[j] == toward)
        g.ravel()[np.arange(0, g.size, WIDTH) + y] += 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")  # 16 bits are sorted by radix
        s = flat[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        at = s[first]
        # as complex numbers, which adds two of a row's numbers at once
        total = np.add.reduceat(g.view(np.complex64).take(order // wide, axis=0), first, axis=0).view(np.float32)
        q = squares[at] + np.einsum("ij,ij->i", total, total) / WIDTH
        squares[at] = q
        total *= (RATE / np.sqrt(q))[:, None]
        total += weights.take(at, axis=0, mode="clip")
        weights[at] = total
        self.touched[level, at] += np.diff(np.append(first, len(s)))

    def lean(self, level: int, state: np.ndarray, p: np.ndarray, right: np.ndarray) -> None:
        """A step of the expectations' weights: p is what the outcome had, right whether it came."""
        slope, curve = np.bincount(state, right - p, STATES), np.bincount(state, p * (1 - p), STATES)
        self.lead[level] += np.clip(LEAN * slope / (curve + 1), -1, 1)
        self.tried[level] += np.bincount(state, minlength=STATES)

    def block(self, block: Block) -> None:
        """Learns a block's training tokens."""
        own = ~block.held[block.owner]
        for _, path, at, rows, told, owner in block.slices(own):
            mine = ~block.held[owner]
            for a in range(0, len(path), BATCH):
                s = slice(a, a + BATCH)
                for level in range(LEVELS):
                    i = a + np.flatnonzero(mine[s] & (at[level][s] >= 0))
                    if len(i):
                        self.learn(level, rows[level][i], at[level][i], path[i, level], told, i)
                i = a + np.flatnonzero(mine[s] & (told.state[LEVELS][s] >= 0))
                state = told.state[LEVELS][i]
                self.lean(LEVELS, state, 1 / (1 + np.exp(-self.lead[LEVELS][state])), told.hit[i])

    def leaned(self) -> bytes:
        """How often expectations were tried, and the changes of their weights times that."""
        return np.stack((self.tried, (self.lead - self.lead_begin) * self.tried)).astype("<f8").tobytes()

    def changes(self, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """part, rows, how often each was touched, changes of their weights."""
        touched = self.touched.ravel()
        at = np.flatnonzero(touched)
        change = (self.weights - self.begin).reshape(-1, WIDTH)[at].astype(np.float16)
        cut = np.searchsorted(at * parts // len(touched), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[p], cut[p + 1])
            yield p, at[s].astype("<u4").tobytes(), touched[at[s]].astype("<f8").tobytes(), change[s].astype("<f2").tobytes()


_CHANGES = ["part", "block", "at", "touched", "change"]


def _merge(last: bool):
    """Sums of changes times touches of a range's rows; at last, their means. Range -1: sums of the expectations' tries and changes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py() // FAN
        if part < 0:
            columns = (b"", b"", sum(np.frombuffer(x, "<f8") for x in table.column("change").to_pylist()).tobytes())
        else:
            total, weight = np.zeros((LEVELS * ROWS, WIDTH)), np.zeros(LEVELS * ROWS)
            for at, touched, change in zip(*(table.column(c).to_pylist() for c in ("at", "touched", "change")), strict=True):
                i, t = np.frombuffer(at, "<u4"), np.frombuffer(touched, "<f8")
                own = len(change) == 2 * WIDTH * len(i)  # of one block, not yet a sum
                total[i] += np.frombuffer(change, "<f2").reshape(-1, WIDTH) * t[:, None] if own else np.frombuffer(change, "<f8").reshape(-1, WIDTH)
                weight[i] += t
            i = np.flatnonzero(weight)
            columns = (i.astype("<u4").tobytes(), weight[i].tobytes(), ((total[i] / weight[i, None]).astype("<f4") if last else total[i]).tobytes())
        return pa.table([pa.array([part], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], names=_CHANGES)

    return run


def _dealt(blocks: DataFrame, number: Column | None = None) -> DataFrame:
    """Blocks in turn to all tasks, so that none gets two more than another."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select("block").repartitionById(tasks, ((F.col("block") if number is None else number) % tasks).cast("int"))


def train(path: str, made: DataFrame, words: Words, parts: int, expecting: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The weights after all rounds, and those of expectations."""
    spark = made.sparkSession
    weights, lead = np.zeros((LEVELS, ROWS, WIDTH), np.float32), first_lead()
    schema = "part int, block long, at binary, touched binary, change binary"
    most = made.agg(F.max("block")).first()[0]
    for n in range(ROUNDS if most is not None else 0):
        now = spark.sparkContext.broadcast((weights, lead, words))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            start, lead, words = now.value
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    task = Trainer(start, lead, words.bias)
                    task.block(Block(path, block, words, parts, expecting))
                    rows = [(-1, b"", b"", task.leaned()), *task.changes(64)]
                    ids = [pa.array([r[0] for r in rows], pa.int32()), pa.array([block // ROUNDS] * len(rows), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=_CHANGES)

        mine = _dealt(made.where(F.col("block") % ROUNDS == n), F.floor(F.col("block") / ROUNDS))
        moved, size = mine.mapInArrow(run, schema), most // ROUNDS + 1
        while size > FAN:
            moved = moved.groupBy("part", F.floor(F.col("block") / FAN)).applyInArrow(_merge(False), schema)
            size = -(-size // FAN)
        weights = weights.copy()
        flat = weights.reshape(-1, WIDTH)
        with lean(spark):
            found = moved.groupBy("part").applyInArrow(_merge(True), schema).select("part", "at", "change").collect()  # the weights' size at most
        for r in found:
            if r["part"] < 0:
                tried, change = np.frombuffer(r["change"], "<f8").reshape(2, LEVELS + 1, STATES)
                lead = lead + change / np.maximum(tried, 1)
            else:
                flat[np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["change"], "<f4").reshape(-1, WIDTH)
        now.unpersist()
    return weights, lead


def _make(path: str, count: int):
    """From rows sorted by block and hash: the blocks' files. Rows beyond twice a block's size (one row many times) go to blocks ``count`` further on."""

    def store(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        h, k, owner = tokens(table.column("text"))
        known, at, inverse = numbered(h)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=table.num_rows)))).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(inverse))
        B.save(_file(path, block), pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "tokens": lists}))
        B.save(_file(path, block) + ".words", pa.table({"h": known, "k": k[at]}))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, held, size = None, 0, [], 0
        for batch in batches:
            numbers, offs = batch.column(0).to_numpy(), X.flat(batch.column(2))[1]
            a = 0
            while a < batch.num_rows:
                full = size >= 2 * BLOCK
                if held and (full or numbers[a] != now):
                    yield from store(now + piece * count, held)
                    held, size = [], 0
                    piece += 1
                if numbers[a] != now:
                    now, piece = int(numbers[a]), 0
                room = int(np.searchsorted(offs, offs[a] + 2 * BLOCK - size))  # the row that fills it is its last
                b = max(a + 1, min(int(np.searchsorted(numbers, now, side="right")), room))
                held.append(batch.slice(a, b - a))
                size += int(offs[b] - offs[a])
                a = b
        if held:
            yield from store(now + piece * count, held)

    return run


def _asked(path: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                table, n, known, k, inverse = load(path, block)
                owner = np.repeat(np.arange(len(n)), n)
                training = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[owner]
                rows = list(_ask(known[inverse], known, k, inverse, training, owner, parts))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["part", "block", "blob"])

    return run


def _answer(parts: int):
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("v", pa.int64()), ("k", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        part, blocks, blobs = table.column("part")[0].as_py(), table.column("block").to_pylist(), table.column("blob").to_pylist()
        replies, more = (_continue(blobs, context_bits(parts)), None) if part >= parts else _count_words(blobs)
        out = pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array([part] * len(blocks), pa.int32()), "blob": pa.array(replies, pa.binary())})
        out = pa.table([*out.columns, *(pa.nulls(len(blocks), f.type) for f in list(schema)[3:])], schema=schema)
        if more is not None:
            n = more.num_rows
            out = pa.concat_tables([out, pa.table([pa.nulls(n, f.type) for f in list(schema)[:3]] + [more.column(c) for c in ("kind", "h", "c", "v", "k")], schema=schema)])
        return out

    return run, "block long, part int, blob binary, kind int, h long, c long, v long, k int"


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trained: bool = True, expecting: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Without trained, only what counts give (and expectations as they are before training); without expecting, no expectations: for measuring what each part adds.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, parts = max(LEAST, -(-size // (ROUNDS * BLOCK)) * ROUNDS), max(4, -(-size // RANGE))
    path = scratch(spark, "blocks")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    key = F.xxhash64("doc_id", "text")
    dealt = rows.select(F.pmod(key, F.lit(count)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), key.alias("key"))
    tasks = min(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block", "key", "doc_id", "text")
    made = written(dealt.mapInArrow(_make(path, count), "block long"), "blocks")
    asked = _dealt(made).mapInArrow(_asked(path, parts), "part int, block long, blob binary")
    run, schema = _answer(parts)
    answers = written(asked.groupBy("part").applyInArrow(run, schema), "word-counts")
    sums = answers.where("kind < 0").groupBy("kind", "k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()  # a hundred cells and the end
    frequent = answers.where("kind = 0").orderBy(F.col("c").desc(), "h").limit(CANDIDATES).select("h", "c", "k").collect()
    # a word for each code, 2^TELL at most; of equally frequent ones the one whose hash is the smallest, as a signed number
    told = answers.where("kind = 1").groupBy(F.shiftrightunsigned("h", 64 - TELL).alias("code")).agg(F.min(F.struct((-F.col("c")).alias("c"), "h", "k")).alias("w")).select("w.h", (-F.col("w.c")).alias("c"), "w.k").collect()
    end = next(((r["c"], r["v"]) for r in sums if r["kind"] == -2), (0, 0))
    words = Words([(r["k"], r["c"], r["v"]) for r in sums if r["kind"] == -1], end, *([(r["h"] % (1 << 64), r["c"], r["k"]) for r in rows_] for rows_ in (frequent, told)))

    def keep(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        B.save(f"{_file(path, block)}.counts", table.select(["part", "blob"]).sort_by("part"))
        return pa.table({"block": pa.array([block], pa.int64())})

    made = written(answers.where("block is not null").groupBy("block").applyInArrow(keep, "block long"), "counted-blocks")
    removed(answers)
    weights, lead = train(path, made if trained else made.limit(0), words, parts, expecting)
    given = spark.sparkContext.broadcast((weights, lead, words))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lead, words = given.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                block = Block(path, number, words, parts, expecting)
                n = block.table.num_rows
                c = block.count[block.inverse]
                sums = lambda x, o=block.owner, n=n: np.bincount(o, weights=x, minlength=n)
                columns = [pa.array(np.bincount(block.owner, minlength=n).astype(np.int64)), pa.array(sums(c > 0).astype(np.int64)), pa.array(np.full(n, words.n)), pa.array(sums(words.base(c))), pa.array(sums(block.score(weights, lead) / np.log(10)))]
                yield pa.RecordBatch.from_arrays([block.table.column("doc_id").combine_chunks(), block.table.column("held_out").combine_chunks(), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _dealt(made).mapInArrow(results, shape)
