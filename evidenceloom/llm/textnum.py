"""Words, lines and windows of many texts at once, as numpy arrays over their UTF-8 bytes.

The word patterns of the operators split UTF-8 at single bytes below 0x80, so splitting bytes equals
splitting code points. Hashes are 64-bit sums ``sum(T[byte] * B**i) mod 2**64`` (T: pseudo-random,
B: odd), moved to a common origin and mixed; prefix sums give the hash of any span in one step.
Memory is about 60 bytes for each byte of a piece; pieces are cut between texts at ``PIECE`` bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U = np.uint64
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix((np.arange(1, 257, dtype=U)) * U(0x9E3779B97F4A7C15))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base & _M64, dtype=U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i up to n at least."""
    size = 1 << 19
    while size < n:
        size *= 2
    return _powers(size)


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


SPACE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~SPACE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = _table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
NOT_NEWLINE = ~_table(b"\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each value's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int | None = None):
    """Ranges (i, j) of values that hold at most limit (PIECE) bytes, or one value."""
    limit = limit or PIECE
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and value numbers of the maximal runs of bytes of a kind; none crosses values."""
    n = len(buf)
    if not n:
        return (np.empty(0, np.int64),) * 3
    inside = kind[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    s = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(_TABLE[buf] * powers(len(buf))[0][: len(buf)], out=s[1:])
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of so many consecutive items of one owner, and where the windows start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    out = np.zeros(n, dtype=U)
    for j in range(width):
        out = out * U(0xFF51AFD7ED558CCD) + hashes[j : j + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(out[at]), at


def covered(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Which of n items lie in a window that starts at one of starts."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + width, -1)
    return np.cumsum(d[:-1]) > 0


def per_value(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flags (one for each byte) by value."""
    s = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=s[1:])
    return s[offs[1:]] - s[offs[:-1]]
