"""Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

Each row is a leaf: the digest of its fields. The leaves of one language, by id, form a tree of FAN children a node, and the
languages' subroots, in order, another such tree, whose root stands for the dataset. A vertex is a subtree of LEVELS levels (512 leaves
at most). In each superstep upward vertices that have all their children hash them and send their top digest to their parent, which is complete when
its children are, until every tree has one vertex; then the reverse supersteps send each vertex the sibling path of its
top digest, which it continues to each child, down to the leaves. There a leaf's digest is folded with its siblings
and held against the root.

A superstep shuffles one digest for each vertex, so 1/512 of the step before; the leaves themselves are
shuffled once. Places of leaves come from a range sort with the ranges' sizes added up, so a language of a third or
more of all rows is many ranges and many vertices. The driver sees the number of supersteps and one root. Nothing is kept on one
executor only: leaves are a written table, and lost vertices are made again from it.

A field enters as its count of UTF-8 bytes, ':', and its value, a null as '-'. Verification lower-cases A-Z in the texts of some
documents and folds the changed leaf with the original siblings: such a leaf is verified only if its text had none.

Defined results: of equal ids the lesser leaf digest comes first, and equal rows are leaves of their own; null ids come last and are not
tampered with; a null language is one of its own, the first; a null text differs from an empty one; an empty table gives an empty
result; further columns do not enter a leaf and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import before, numbered, parts_for, ranked
from .shared import written

FAN, LEVELS = 8, 3
#: Leaves of a task.
TASK_LEAVES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level of a path: the place among the run's nodes, and the digests of the others.
Level = tuple[int, list[str]]


def H(parts: Iterable[str]) -> str:  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: Iterable[Column]) -> Column:
    said = (F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns)
    return F.sha2(F.concat(*said), 256)


def _levels(nodes: list[str], whole: int, levels: int) -> list[list[str]]:
    """A vertex's nodes level by level, its top one alone in the last. whole: nodes of the tree on the vertex's lowest level."""
    out = [nodes]
    while whole > 1 and len(out) <= levels:
        below = out[-1]
        out.append([H(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        whole = -(-whole // FAN)
    return out


def _paths(levels: list[list[str]]) -> Iterator[list[Level]]:
    """The path of each of a vertex's lowest nodes to its top."""
    for i in range(len(levels[0])):
        path = []
        for nodes in levels[:-1]:
            run = i // FAN * FAN
            path.append((i - run, nodes[run:i] + nodes[i + 1 : run + FAN]))
            i //= FAN
        yield path


def fold(digest: str, path: Iterable[Level]) -> str:
    for place, others in path:
        digest = H((*others[:place], digest, *others[place:]))
    return digest


def _vertices(nodes: RDD, parts: int, levels: int) -> RDD:
    """(tree, vertex), its (place, nodes of its level in the tree, digest, ...) in order, from (tree, place, nodes of the level, digest, ...). FAN^levels to a vertex."""
    run = FAN**levels
    sent = nodes.map(lambda r: ((r[0], r[1] // run), (r[1] % run, r[2], *r[3:])))
    return sent.groupByKey(parts).mapValues(lambda found: sorted(found, key=lambda x: x[0]))


def _top(vertex: tuple, levels: int) -> tuple:
    """What a complete vertex tells: (tree, its place, nodes of that level, its top digest)."""
    (tree, place), found = vertex
    whole = found[0][1]
    return tree, place, -(-whole // FAN**levels), _levels([x[2] for x in found], whole, levels)[-1][0]


def _down(key: tuple, found: list[tuple], path: list[Level], levels: int) -> Iterator[tuple]:
    """A vertex's path, continued to each of its children."""
    for x, own in zip(found, _paths(_levels([x[2] for x in found], found[0][1], levels)), strict=True):
        yield (key[0], key[1] * FAN**levels + x[0]), own + path


def grown(nodes: RDD, most: int, parts: int, levels: int) -> tuple[list[RDD], RDD]:
    """The vertices of each superstep upward, and (tree, root digest). most: leaves of the largest tree."""
    steps, roots, run = [], None, FAN**levels
    while True:
        vertices = _vertices(nodes, max(1, parts), levels)
        tops = vertices.map(lambda v: _top(v, levels))
        done = tops.filter(lambda r: r[2] == 1).map(lambda r: (r[0], r[3]))
        roots = done if roots is None else roots.union(done)
        steps.append(vertices)
        if most <= run:
            return steps, roots
        nodes, most, parts = tops.filter(lambda r: r[2] > 1), -(-most // run), -(-parts // run)


def paths(steps: list[RDD], above: RDD, parts: int, levels: int) -> RDD:
    """((tree, vertex), path from the vertex's top) of the first step's vertices; above: (tree, path from the tree's root)."""
    come = above.map(lambda r: ((r[0], 0), r[1]))
    for vertices in reversed(steps[1:]):
        # a tree that has its root below has no vertex here: what it was sent waits for the step it belongs to
        met = vertices.cogroup(come, max(1, parts))
        come = met.flatMap(lambda r: _passed(r[0], *map(list, r[1]), levels))
    return come


def _passed(key: tuple, own: list, sent: list, levels: int) -> Iterator[tuple]:
    if own:
        yield from _down(key, own[0], sent[0], levels)
    else:
        yield from ((key, path) for path in sent)


def _leaves(docs: DataFrame, names: dict[str, str]) -> tuple[DataFrame, int, int]:
    """doc_id, tree, place, whole, leaf, tampered (null: not tampered with); rows, and leaves of the largest tree."""
    spark = docs.sparkSession
    own = {f: F.col(f"`{names.get(f, f)}`") for f in FIELDS}
    said = {f: c.cast("string") for f, c in own.items()}
    chosen = F.crc32(said["doc_id"].cast("binary")) % 3 == 0
    tampered = leaf(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if f == "text" else c for f, c in said.items())
    rows = docs.select(own["doc_id"].alias("doc_id"), said["lang"].alias("lang"), leaf(said.values()).alias("leaf"), F.when(chosen, tampered).alias("tampered"))
    rows = written(rows, "leaf-digests")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("leaf").asc()]
    n = rows.count()
    placed = numbered(rows, order, parts_for(n, TASK_LEAVES, spark), "leaf-order")
    # where each language's part of a range begins in the range, and how many of its leaves are in earlier ranges
    runs = before(placed.groupBy("lang", "_part").agg(F.count("*").alias("_n"), F.min("_index").alias("_first")), ["lang"], "_part", "_n", "_before")
    sizes = runs.groupBy("lang").agg(F.sum("_n").cast("long").alias("whole"))
    trees = ranked(sizes, [F.col("lang").asc_nulls_first()], 1, "languages").select("lang", "whole", F.col("rank").alias("tree"))
    most = trees.agg(F.max("whole")).first()[0] or 0
    runs = runs.join(trees, runs["lang"].eqNullSafe(trees["lang"])).select(runs["lang"].alias("r_lang"), F.col("_part").alias("r_part"), "_first", "_before", "whole", "tree")
    joined = placed.join(runs, (placed["_part"] == runs["r_part"]) & placed["lang"].eqNullSafe(runs["r_lang"]))
    out = joined.select("doc_id", "tree", (F.col("_before") + F.col("_index") - F.col("_first")).alias("place"), "whole", "leaf", "tampered")
    return written(out, "leaves"), n, most


def verify(docs: DataFrame, levels: int = LEVELS, **names: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. levels: of the tree that a vertex holds; names: docs' columns, where they are called otherwise than FIELDS."""
    spark = docs.sparkSession
    leaves, n, most = _leaves(docs, names)
    kind = docs.schema[names.get("doc_id", "doc_id")].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not n:
        return spark.createDataFrame([], schema)
    parts = parts_for(n, TASK_LEAVES, spark)
    nodes = leaves.select("tree", "place", "whole", "leaf", "doc_id", "tampered").rdd.map(tuple)
    steps, subroots = grown(nodes, most, parts, levels)
    langs = leaves.agg(F.max("tree")).first()[0] + 1
    few = -(-parts // FAN**levels)
    top, ended = grown(subroots.map(lambda r: (0, r[0], langs, r[1])), langs, few, levels)
    root = ended.first()[1]
    # down the tree of languages, then down each language's own
    sent = paths(top, spark.sparkContext.parallelize([(0, [])], 1), few, levels)
    above = top[0].join(sent).flatMap(lambda v: _down(v[0], *v[1], levels)).map(lambda r: (r[0][1], r[1])).join(subroots)
    subroot = above.map(lambda r: (r[0], [("subroot", r[1][1]), *r[1][0]]))
    return spark.createDataFrame(steps[0].join(paths(steps, subroot, parts, levels), parts).flatMap(lambda v: _proved(*v[1], root, levels)), schema, verifySchema=False)


def _proved(found: list[tuple], path: list, root: str, levels: int) -> Iterator[tuple]:
    at = next(i for i, x in enumerate(path) if x[0] == "subroot")
    subroot, path = path[at][1], path[:at] + path[at + 1 :]
    tail = "".join(d for _, others in path for d in others)
    for (_, _, digest, doc_id, tampered), own in zip(found, _paths(_levels([x[2] for x in found], found[0][1], levels)), strict=True):
        folded = fold(fold(tampered or digest, own), path)
        yield doc_id, digest, subroot, root, H([*(d for _, others in own for d in others), tail]), folded, folded == root


def _fields(text: str) -> str:
    said = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in said)


#: The same over the table documents, for DuckDB; trees level by level, paths by each node's run.
SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, sha256({_fields("text")}) AS leaf, sha256({_fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS other FROM documents),
crc(n, v) AS (SELECT i, i::BIGINT FROM range(256) g(i)),
bits AS (SELECT n, list_reduce([v, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM crc),
code AS (SELECT list(v ORDER BY n) AS t FROM bits),
marked AS (SELECT docs.*, coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS chosen FROM docs, code),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM marked),
low(lang, lvl, i, n, d) AS (
  SELECT lang, 0, i, n, leaf FROM leaves
  UNION ALL SELECT lang, lvl + 1, i // {FAN}, ceil(n / {FAN})::BIGINT, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, lvl, i // {FAN}, n),
langs AS (SELECT lang, d AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, i, n, d) AS (
  SELECT 0, k, n, subroot FROM langs
  UNION ALL SELECT lvl + 1, i // {FAN}, ceil(n / {FAN})::BIGINT, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // {FAN}, n),
nodes AS (
  SELECT lang, NULL::BIGINT AS k, lvl, i, d FROM low WHERE n > 1
  UNION ALL SELECT l.lang, l.k, height + h.lvl, h.i, h.d FROM high h JOIN langs l ON l.k // ({FAN}**(h.lvl + 1))::BIGINT = h.i // {FAN} WHERE h.n > 1),
runs AS (SELECT lang, k, lvl, i // {FAN} AS run, list(struct_pack(i := i, d := d) ORDER BY i) AS run_nodes FROM nodes GROUP BY ALL),
found AS (
  SELECT l.*, g.subroot, r.lvl, CASE WHEN r.k IS NULL THEN l.i ELSE g.k END // ({FAN}**(r.lvl - CASE WHEN r.k IS NULL THEN 0 ELSE g.height END))::BIGINT AS own, r.run_nodes
  FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang LEFT JOIN runs r ON r.lang IS NOT DISTINCT FROM l.lang
    AND r.run = CASE WHEN r.k IS NULL THEN l.i ELSE g.k END // ({FAN}**(r.lvl + 1 - CASE WHEN r.k IS NULL THEN 0 ELSE g.height END))::BIGINT),
sides AS (
  SELECT lang, i, lvl, array_to_string(list_transform(list_filter(run_nodes, lambda x: x.i < own), lambda x: x.d), '') AS before, array_to_string(list_transform(list_filter(run_nodes, lambda x: x.i > own), lambda x: x.d), '') AS after FROM found),
proofs AS (SELECT lang, i, sha256(coalesce(string_agg(before || after, '' ORDER BY lvl), '')) AS proof_sha256, list(struct_pack(b := before, a := after) ORDER BY lvl) FILTER (lvl IS NOT NULL) AS path FROM sides GROUP BY lang, i)
SELECT doc_id, leaf, subroot, h.d AS root, proof_sha256,
  list_reduce(list_prepend(struct_pack(b := CASE WHEN chosen THEN other ELSE leaf END, a := ''), coalesce(path, [])), lambda x, y: struct_pack(b := sha256(y.b || x.b || y.a), a := '')).b AS folded_root, folded_root = h.d AS verified
FROM leaves l JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.i = p.i JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang JOIN high h ON h.n = 1
"""
