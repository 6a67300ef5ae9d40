"""Mixing, clustering and the manifest against plain Python, on odd tables and where one key holds most rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenceloom.llm import centroids, merkle, mixing

from . import cases

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, size int, leaf string"


def odd_rows():
    rng = random.Random(4)
    out = [(i, rng.choice(["hot", "hot", "a", "B", "ä", None, "\U0001f600", "￿"]), rng.choice(["en", None, "de", "\U0001f600", "￿"]), rng.choice([None, 3]), t, 1, "x") for i, t in cases.ODD]
    out += [(100 + i, "hot", "en", 5, f"hot words {'again ' * (i % 7)}", 1, "x") for i in range(700)]
    out += [(5000, "hot", "en", 1, "the same row", 1, "x")] * 90
    out += [(None, "nul", None, None, f"no id {i}", 1, "x") for i in range(20)]
    out += [(7000, "empty", "fr", 0, "", 1, "x"), (7001, "small", "fr", 0, "two words", 1, "x")]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


# ---- mixing


def fair(rows, weights=(1, 2, 3), budget=None, seed=mixing.SEED):
    """(doc_id, source, size, source_size, target, taken) of each row, by a queue that is really sorted."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sized = [(i, s, t, len(cases.words(t))) for i, s, t in rows]
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = Counter()
    for _, s, _, n in sized:
        total[s] += n
    budget = sum(total.values()) if budget is None else budget
    target, open_ = {s: 0.0 for s in names}, set(names)
    while open_:
        left = budget - sum(target[s] for s in names if s not in open_)
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * total[s]}
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else left * weight[s] / w
        open_ -= over or open_
    queue = []
    for s in names:
        own = sorted((md5(f"{seed}:{'-' if i is None else i}:{md5(t or '')}"), i is not None, i or 0, md5(t or ""), r) for r, (i, x, t, _) in enumerate(sized) if x == s)
        upto = 0
        for e in range(3):
            for *_, r in own:
                upto += sized[r][3]
                if sized[r][3]:
                    queue.append((upto / weight[s], names.index(s), r))
    taken, spent = Counter(), 0
    for _, _, r in sorted(queue):
        if spent + sized[r][3] > budget:
            break
        spent += sized[r][3]
        taken[r] += sized[r][3]
    return [(i, s, n, total[s], round(target[s], 6), taken[r]) for r, (i, s, _, n) in enumerate(sized)]


def planned(df, **more):
    return [(r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan(df, **more).collect()]


def test_mix_of_odd_rows(odd):
    rows = [(r[0], r[1], r[4]) for r in odd_rows()]
    assert sorted(planned(odd), key=repr) == sorted(fair(rows), key=repr)
    assert sorted(planned(odd, budget=900), key=repr) == sorted(fair(rows, budget=900), key=repr)


def test_mix_in_small_ranges(monkeypatch, odd):
    """Many ranges, spans and tasks to a source, and equal rows in shares."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "SPAN_WORDS", 50)
    assert sorted(planned(odd), key=repr) == sorted(fair([(r[0], r[1], r[4]) for r in odd_rows()]), key=repr)


def test_mix_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(planned(docs.repartition(1)), key=repr) == sorted(planned(docs.repartition(13)), key=repr)


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = planned(docs)
    total, target, longest = Counter(), {}, Counter()
    for _, s, size, of, t, taken in found:
        assert taken % max(size, 1) == 0 and taken <= 3 * size and t <= 3 * of + 1e-6
        total[s], target[s], longest[s] = total[s] + taken, t, max(longest[s], size)
    budget = sum(r[2] for r in found)
    assert math.isclose(sum(target.values()), budget)
    assert budget - max(longest.values()) < sum(total.values()) <= budget
    assert all(abs(total[s] - target[s]) <= max(longest.values()) for s in total)


def test_mix_itself(spark, odd):
    """The stream has each row as often as it is taken, in order of virtual time, and budgets hold along it."""
    got = [tuple(r) for r in mixing.mixed(odd).select("doc_id", "source", "text", "mix_time").collect()]
    assert [g[3] for g in got] == sorted(g[3] for g in got)
    want = defaultdict(int)
    for (i, s, t), f in zip([(r[0], r[1], r[4]) for r in odd_rows()], fair([(r[0], r[1], r[4]) for r in odd_rows()]), strict=True):
        want[i, s, t] += f[5] // max(f[2], 1)
    assert Counter(g[:3] for g in got) == Counter({k: n for k, n in want.items() if n})
    clash = odd.withColumn("mix_time", F.lit("own"))
    assert "_mix_time" in mixing.mixed(clash).columns


@pytest.mark.parametrize("texts", [[], [None, ""], ["one"]])
def test_mix_of_few(spark, texts):
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    assert sorted(planned(df), key=repr) == sorted(fair([(k, "s", t) for k, t in enumerate(texts)]), key=repr)
    assert mixing.mixed(df).count() == sum(1 for t in texts if t)


# ---- centroids


def lloyd(rows, k, rounds, seed=2):
    """(vec_id, cluster, distance) by full scans, and the centroids."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'-' if i is None else i}".encode()).hexdigest(), x) for i, x in good)[:k]
    c = [x for _, x in first]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for r in range(rounds + 1):
        best = [min((d(x, y), j) for j, y in enumerate(c)) for _, x in good]
        if r < rounds:
            for j in range(len(c)):
                own = [x for (_, x), (_, b) in zip(good, best, strict=True) if b == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, b, x) for (i, _), (x, b) in zip(good, best, strict=True)], c


def odd_vectors():
    rng = random.Random(9)
    lumps = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(6)]
    out = [(i, [x + rng.gauss(0, 0.3) for x in lumps[i % 6]]) for i in range(240)]
    out += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [float("nan")] * 64), (1005, [float("-inf")] * 64), (1006, [1.0] * 65)]
    out += [(i, lumps[0]) for i in range(2000, 2120)]  # a third: copies
    out += [(None, lumps[1]), (None, lumps[2]), (5, lumps[3]), (5, lumps[3]), (3000, [0.0] * 64), (3001, [1000.0] * 64)]
    return out


@pytest.mark.parametrize("k", [1, 2, 12, 1000])
def test_centroids(spark, k):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("own")).repartition(7)
    got = centroids.cluster(df, k=k).collect()
    want, c = lloyd(rows, k, centroids.ROUNDS)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    inertia = Counter()
    for _, b, x in want:
        inertia[b] += x
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_centroids_with_ties_on_a_grid(spark):
    """Small integers: distances are often equal, and the smaller number wins."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([0, 1]) / 256 if j < 5 else 0.0 for j in range(64)]) for i in range(300)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=9).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(lloyd(rows, 9, centroids.ROUNDS)[0])


def test_bounds_spare_scans(spark):
    """Where vectors lie in lumps, most are not scanned again; the exact outcome is that of full scans."""
    rng = np.random.default_rng(1)
    lumps = rng.normal(size=(8, 64)) * 3
    rows = [(i, (lumps[i % 8] + rng.normal(size=64) * 0.1).tolist()) for i in range(800)]
    state, _ = centroids.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8)
    assert state.where("scanned").count() < 400
    assert sorted((r.vec_id, r.cluster, r.distance) for r in state.collect()) == sorted(lloyd(rows, 8, centroids.ROUNDS)[0])


def test_bounds_hold():
    """After any drift the upper bound is at least the true distance and the lower one at most the second nearest's."""
    rng = np.random.default_rng(3)
    x = rng.integers(-400, 400, (500, 64))
    c = x[:7].copy()
    state = centroids.step(x, None, None, None, c, None)
    for _ in range(6):
        new = c + rng.integers(-30, 30, c.shape)
        state = centroids.step(x, *state[:3], new, c)
        c = new
        d = np.sort(np.sqrt(centroids.distances(x, c).astype(float)), 1)
        exact = centroids.distances(x, c)
        assert (state[0] == exact.argmin(1)).all() and (state[3] == exact.min(1)).all()
        assert (state[1] >= d[:, 0]).all() and (state[2] <= d[:, 1]).all()


def test_centroids_of_large_components_and_none(spark):
    big = [(i, [float((i * 7919 + j) % 200_000) for j in range(64)]) for i in range(40)]
    got = centroids.cluster(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=5).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(lloyd(big, 5, centroids.ROUNDS)[0])
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))
    assert centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).count() == 0


# ---- manifest


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root and each leaf's path: (place among the run, run)."""
    paths, level = [[] for _ in leaves], leaves
    at = list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            run = i // 8 * 8
            p.append((i - run, level[run : run + 8]))
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        low[x] = tree([leaf(r) for r in by[x]])
    root, high = tree([low[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, path in zip(by[x], low[x][1], strict=True):
            path = path + high[k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            d = leaf((*r[:4], cases.lower(r[4]) if r[4] is not None else None)) if changed else leaf(r)
            for i, run in path:
                d = H(*run[:i], d, *run[i + 1 :])
            out.append((r[0], leaf(r), low[x][0], root, H(*(y for i, run in path for j, y in enumerate(run) if j != i)), d, d == root))
    return out


def proved(df, **more):
    return sorted(map(tuple, merkle.verify(df, **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_of_odd_rows(odd):
    rows = [r[:5] for r in odd_rows()]
    assert proved(odd) == sorted(manifest(rows), key=repr)


@pytest.mark.parametrize("levels", [1, 3])
@pytest.mark.parametrize("counts", [(1,), (8,), (9, 1), (64, 65, 3), (513, 7, 8, 1, 1, 1, 1, 1, 1), (700,) + (1,) * 70])
def test_manifest_of_trees_of_all_heights(spark, levels, counts):
    """Full and ragged runs, trees that end in different supersteps, more languages than a run."""
    rows = [(1000 * k + i, "s", f"l{k:02}", 1, f"T{i}") for k, n in enumerate(counts) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert proved(df, levels=levels) == sorted(manifest(rows), key=repr)


def test_manifest_of_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verify(empty).count() == 0
