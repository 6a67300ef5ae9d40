"""Small tables with what operators must bear, and plain restatements of what they compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(9000))
ODD = [
    (0, "Plain words in a row, and more of them."),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "ÄÖÜ straße ñandú \U0001f600 x́ 'Re-read'  it's  \n\n two   blanks"),
    (6, "Plain words in a row, and more of them."),
    (6, "Plain words in a row, and more of them."),
    (7, LONG),
    (8, "x" * 3000),
    (9, "a b c a b c a b c\na b c\n\na b c\n"),
    (10, "l1\nl2\nl3\nl4\nl5"),
    (11, "zero\nl2\nl3\nl4\nl5\r\nl6"),
    (None, "Plain words in a row, and more of them."),
    (12, "<|endoftext|> ### $$$ | | | <b>"),
    (13, LONG + " tail"),
]
SCHEMA = "doc_id long, text string, n_words string, fp int, token_ids string, kept int, marks string"


def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in ODD], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    rep = {i + j for x in at.values() if len(x) > 1 for i in x for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def contamination(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def simhash(text):
    import xxhash

    w = words(lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    bits = Counter(b for x in s for h in [xxhash.xxh64_intdigest(x.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in bits if 2 * bits[b] > len(s))


def groups(ids, linked):
    """Smallest id that links lead to, of each."""
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                label[root(i)] = root(j)
    smallest = {}
    for i, x in enumerate(ids):
        r = root(i)
        smallest[r] = min((y for y in (x, smallest.get(r)) if y is not None), default=None)
    return [smallest[root(i)] for i in range(len(ids))]


def line_dedup(rows):
    """Kept text of each (id, text)."""
    key = [(9223372036854775807 if i is None else i) for i, _ in rows]
    split = [None if t is None else t.split("\n") for _, t in rows]
    first, at = {}, defaultdict(list)
    for r, s in enumerate(split):
        for i in range(len(s or []) - 2):
            w = tuple(x.strip(" \t\r") for x in s[i : i + 3])
            if any(w):
                first[w] = min(first.get(w, (key[r], i)), (key[r], i))
                at[w].append((r, i))
    gone = defaultdict(set)
    for w, places in at.items():
        for r, i in places:
            if (key[r], i) > first[w]:
                gone[r] |= {i, i + 1, i + 2}
    return [None if s is None else "\n".join(x for i, x in enumerate(s) if i not in gone[r]) for r, s in enumerate(split)]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
