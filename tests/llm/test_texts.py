import json
import math
from collections import Counter
import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidenceloom.llm import bpe, decontaminate, linededup, quality, queries, simhash, tokenfile

from . import cases

SF = "/root/testdata/sf0.001"


def real(spark, n=200):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    return real(spark) + cases.ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_quality_measures(docs, texts):
    got = by_row(quality.judge(docs), "doc_id", "text", *quality.COUNTS, "base_failed")
    want = []
    for i, t in texts:
        m = cases.quality(t)
        want.append((i, t, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want, key=repr)


def test_quality_verdict_follows_labels(spark):
    sf = "/root/testdata/sf0.01"
    verdict = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = verdict.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * n[0, False]


def test_estimate_is_a_mixture():
    n = len(quality.RULES)
    good, bad = (1,) * n, (-1,) * n
    posterior, share, accuracy = quality.estimate({good: 900, bad: 100, (1, -1, *[0] * (n - 2)): 3})
    assert posterior[good] > 0.99 > 0.01 > posterior[bad]
    assert 0.85 < share < 0.95 and (accuracy >= 0.55).all()


def test_decontaminate(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(1000, "one"), (1001, None), (1002, "..."), (1003, "Words in a row, and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *cases.contamination(t, items)) for i, t in texts], key=repr)
    for limit in (decontaminate.BROADCAST_WINDOWS, 20):
        got = decontaminate.scan(docs, bench, limit=limit)
        assert by_row(got.withColumn("n", F.size("items")).withColumn("d", F.sha2(F.array_join("items", ","), 256)), "doc_id", "n_words", "n_hit", "n", "d") == want
    plain = {r["text"]: r["kept_text"] for r in got.where("n_hit > 0").collect()}
    assert plain["Plain words in a row, and more of them."] == "Plain  more of them."


def test_decontaminate_words_of_any_length(spark):
    """Scripts without blanks make words of any length: they are kept by their digests, and groups end at their bytes too."""
    long, other = "字" * 5000, "字" * 4999 + "子"
    items = [(1, long), (2, f"{long} und {other}"), (3, "x" * 64), (4, "x" * 65), (5, " ".join([other] * 12)), (6, "short one")]
    rows = [(1, f"vor {long} nach"), (2, other), (3, f"{long} UND {other}"), (4, "x" * 64 + " " + "x" * 65), (5, " ".join([other] * 13)), (6, "字" * 4998), (7, "a short one b")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *cases.contamination(t, items)[:3]) for i, t in rows])
    assert sum(r[2] > 0 for r in want) == 5
    kept = [len(w) for _, t in items for w in decontaminate._words(t)[0]]
    assert max(kept) == 65
    for most in (decontaminate.BROADCAST_BYTES, 300, 1):
        assert by_row(decontaminate.scan(docs, bench, most_bytes=most).withColumn("n", F.size("items")), "doc_id", "n_words", "n_hit", "n") == want


def test_bpe(docs, texts):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, path, pattern).collect()), key=repr) == sorted(want, key=repr)
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (200, 40), (50, 8)):
        got = bpe.apply(bpe.decode(bpe.encode(docs, path, pattern, chunk=chunk, overlap=overlap), path).drop("text"), bpe.digesting())
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_token_file(spark, docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((i for i in texts), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), cases.crc(ids)))
    got = sorted(tokenfile.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 2, seq_len=64).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())


def test_token_file_random_access(spark):
    from evidenceloom.llm.shared import scratch

    docs = spark.createDataFrame([(i, f"some words for number {i} " * 9) for i in range(40)], "doc_id long, text string").coalesce(1)
    path = scratch(spark, "shards")
    shards = tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2, seq_len=16).orderBy("shard").collect()
    for s in shards:
        shard = tokenfile.Shard(s["path"].removeprefix("file://"))
        ids = [shard[i] for i in range(len(shard))]
        assert all(len(x) == 16 for x, _ in ids) and sum(int(tokenfile.unpacked(m).sum()) for _, m in ids) == s["n_tokens"]
        assert [tokenfile.unpacked(m).tolist() for _, m in ids[:-1]] == [[True] * 16] * (len(ids) - 1)
        assert not ids[0][0].flags.owndata and not ids[0][1].flags.owndata and ids[0][0].dtype == np.uint16
    with pytest.raises(ValueError, match="eight"):
        tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2, seq_len=20)


def test_token_file_with_a_tokenizer_that_does_not_cut_at_words(spark, texts):
    """Whole texts are encoded then, and ids beyond 16 bits get 32."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokenfile.cuts_at_words(json.loads(tokenfile.loaded(path))) and tokenfile.cuts_at_words(json.loads(tokenfile.loaded(public_tokenizers.path("word_bpe_49k.json"))))
    t = Tokenizer.from_file(path)
    some = [(i, x) for i, x in texts if i is not None and i not in (6,)][:40]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(spark.createDataFrame(some, "doc_id long, text string"), path, 70_000, seq_len=64).collect()}
    for i, x in some:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 70_000]
        assert got[i] == (len(ids), cases.crc(ids))


def test_line_dedup(docs, texts):
    got = by_row(linededup.dedupe(docs), "doc_id", "text", "kept_text")
    assert got == sorted(((i, t, k) for (i, t), k in zip(texts, cases.line_dedup(texts), strict=True)), key=repr)


def test_simhash(docs, texts):
    prints = [cases.simhash(t) for _, t in texts]
    labels = cases.groups([i for i, _ in texts], lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, labels, strict=True)), key=repr)
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize(("most", "size"), [(20, 500), (simhash.MOST, 3000)])
def test_simhash_links_of_large_groups(spark, monkeypatch, most, size):
    """Keys with more fingerprints than are compared with each other, also at the true threshold."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3 if size < 1000 else 1, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(size):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    assert max(Counter((fps >> np.uint64(32)).tolist()).values()) > most
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fps) for b in fps[:i][np.bitwise_count(fps[:i] ^ a) <= 2]}
    nodes = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(nodes).collect()}
    assert got == want


def test_posteriors_are_those_of_a_plain_restatement():
    """Expectation-maximisation over votes by loops: shares, accuracies and posteriors."""
    rng = np.random.default_rng(4)
    k = len(quality.RULES)
    counts = Counter()
    for _ in range(3000):
        good = rng.random() < 0.7
        counts[tuple(int(x) for x in np.where(rng.random(k) < 0.5, 0, np.where(rng.random(k) < 0.85, 1 if good else -1, -1 if good else 1)))] += 1
    share, right = 0.8, [[0.8] * k, [0.8] * k]
    for _ in range(50):
        post = {}
        for votes in counts:
            p = [1 - share, share]
            for j, v in enumerate(votes):
                for c in (0, 1):
                    if v:
                        p[c] *= right[c][j] if (v > 0) == bool(c) else 1 - right[c][j]
            post[votes] = p[1] / (p[0] + p[1])
        weight = [lambda v: counts[v] * (1 - post[v]), lambda v: counts[v] * post[v]]
        right = [[min(0.995, max(0.55, (sum(weight[c](v) for v in counts if v[j] == (1 if c else -1)) + 8) / (sum(weight[c](v) for v in counts if v[j]) + 10))) for j in range(k)] for c in (0, 1)]
        share = min(0.95, max(0.05, (sum(weight[1](v) for v in counts) + 8) / (sum(counts.values()) + 10)))
    found, s, accuracy = quality.estimate(dict(counts))
    assert math.isclose(s, share, rel_tol=1e-9) and np.allclose(accuracy, right)
    assert all(math.isclose(found[v], post[v], rel_tol=1e-9) for v in counts)


def test_kept_follows_from_limits_and_posterior(docs):
    for r in quality.judge(docs).collect():
        n, repeats = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and r.kept == (not r.base_failed and r.posterior >= 0.5)


@pytest.mark.parametrize("make", [cases.odd, cases.none])
def test_odd_tables(spark, make):
    files = queries.tokenizer_files()
    table = make(spark)
    n = table.count()
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        quality.judge(table),
        decontaminate.scan(table, bench),
        bpe.decode(bpe.encode(table, files.ranks, files.pattern), files.ranks, "_token_ids"),
        linededup.dedupe(table),
        simhash.near_duplicates(table),
    ):
        assert df.columns[: len(table.columns)] == table.columns
        assert len({c.lower() for c in df.columns}) == len(df.columns)
        assert len(df.collect()) == n
    assert tokenfile.round_trip(table, files.words, 2).count() == n
