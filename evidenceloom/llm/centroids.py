"""Centroid clustering by Hamerly's bounds, in exact integers.

A component x becomes floor(SCALE * x). Centroids start as the vectors with the smallest sha256 of seed and id. Each
round assigns every vector to its nearest centroid (squared Euclidean distance; ties: the smaller number) and replaces centroids by the
floor of their vectors' means. Each vector persists its cluster, one upper bound (on the distance to its own centroid)
and one lower bound (on the distance to the second nearest); a round loosens both by how far the centroids drifted.
Where the upper bound, made exact, stays below the lower one or below half the way to the next centroid, nothing else
is looked at; every other vector is ambiguous and gets a full scan of all centroids in integers. Bounds are widened by
more than their rounding, and a bound that only equals another is ambiguous, so the outcome is that of full scans.

State is a written table with each round, in place of the one before. Sums are exact, so only vectors that moved are added to one centroid
and taken from another: partial sums by centroid, of one row for each centroid and task. The driver and the broadcasts hold K centroids.

Defined results: vectors that are null, of another length, or hold a null or a non-finite component are left out; repeated ids are vectors
of their own; of equal hashes (repeated and null ids, the null's being '-') the lesser vector in order of components comes first, and of
equal vectors one row each; with fewer vectors than K there are as many centroids, with none no rows; a component beyond 2^27 after scaling is an error, as
its distance would not fit; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT = 1 << 27
#: Below this, sums of products of components are exact in double precision.
_EXACT = 1 << 22
#: More than the rounding of a bound that goes through all rounds.
_SLACK = 1e-12


def _kept(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(f"`{embedding}`")
    good = (F.size(v) == SIZE) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * SCALE) <= LIMIT, F.floor(x.cast("double") * SCALE).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, SIZE)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    if not len(x):
        return np.zeros((0, len(centroids)), np.int64)
    if max(np.abs(x).max(), np.abs(centroids).max()) < _EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + _SLACK if up else 1 - _SLACK)


def step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """New cluster, upper and lower bounds, squared distance, and which vectors were scanned in full. before: the centroids of the round before, None for the first."""
    n, k = len(x), len(centroids)
    if before is None:
        scan = np.ones(n, bool)
        cluster, upper, lower, own = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    else:
        drift = _root(((centroids - before) ** 2).sum(1), True)
        far = np.sort(drift)[-1:] if k == 1 else np.sort(drift)[-2:][::-1]
        others = np.where(np.arange(k) == int(drift.argmax()), far[-1] if k > 1 else 0, far[0])
        between = distances(centroids, centroids)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        half = _root(between.min(1), False) / 2
        upper, lower = (upper + drift[cluster]) * (1 + _SLACK), (lower - others[cluster]) * (1 - _SLACK) - _SLACK
        bound = np.maximum(lower, half[cluster])
        # the distance to the own centroid is wanted anyway: it makes the upper bound exact
        own = ((x - centroids[cluster]) ** 2).sum(1)
        upper = np.minimum(upper, _root(own, True))
        scan = ~(upper < bound)
    if scan.any():
        d = distances(x[scan], centroids)
        near = d.argmin(1)  # the first of equals
        own = own.copy()
        own[scan] = d[np.arange(len(d)), near]
        if k > 1:
            d[np.arange(len(d)), near] = np.iinfo(np.int64).max
            second = _root(d.min(1), False)
        else:
            second = np.full(len(d), np.inf)
        cluster = cluster.copy()
        cluster[scan], upper[scan], lower[scan] = near, _root(own[scan], True), second
    return cluster, upper, lower, own, scan


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after one assignment: was is the cluster before (-1: none)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["x"])
            was = b["cluster"].to_numpy().astype(np.int64)
            cluster, upper, lower, own, scan = step(x, was, b["upper"].to_numpy().copy(), b["lower"].to_numpy().copy(), centroids, before)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["x"], pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array(own), pa.array(scan)], ["vec_id", "x", "cluster", "was", "upper", "lower", "distance", "scanned"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(task, f"vec_id {kind}, x array<int>, cluster int, was int, upper double, lower double, distance long, scanned boolean")


def _moved(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """What moved vectors change in each centroid's count and sums."""
    sides = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).cast("long").alias("s")))).alias("side")
    rows = state.where("cluster != was").select("x", sides).where("side.c >= 0")
    sums = rows.groupBy("side.c").agg(F.sum("side.s").alias("n"), *(F.sum(F.get("x", F.lit(i)) * F.col("side.s")).alias(f"s{i}") for i in range(SIZE)))
    return {r.c: (r.n, list(r)[2:]) for r in sums.collect()}  # K rows at most


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The last assignment as a written table (vec_id, x, cluster, distance, upper, lower, scanned), and the centroids."""
    kept = written(_kept(vectors, vec_id, embedding), "vectors")
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("-"))), 256)
    first = kept.select(turn.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, SIZE)
    state = kept.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    if not len(centroids):
        return state.select("vec_id", "x", "cluster", "upper", "lower", F.lit(0).cast("long").alias("distance"), F.lit(True).alias("scanned")), centroids
    n, sums, before, old = [0] * len(centroids), [[0] * SIZE for _ in centroids], None, kept
    for r in range(rounds + 1):
        new = written(assigned(state, centroids, before), "assigned")
        removed(old)
        old = new
        state = new.drop("was", "distance", "scanned")
        if r == rounds:
            break
        for c, (m, s) in _moved(new).items():
            n[c], sums[c] = n[c] + m, [a + b for a, b in zip(sums[c], s, strict=True)]
        before, centroids = centroids, np.array([[s // n[c] for s in sums[c]] if n[c] else list(centroids[c]) for c in range(len(centroids))], np.int64)
    return new, centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centroids = fit(vectors, k, rounds, seed, vec_id, embedding)
    inertia = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # K rows at most
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    of = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same over the table embeddings, for DuckDB: full scans in every round."""
    nearest = "SELECT v.r, min(struct_pack(d := list_sum(list_transform(range(1, {s} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), c := c.c)) AS best FROM v, {c} c GROUP BY v.r"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(s=SIZE, c=f'c{r}')})")
        if r < ROUNDS:
            steps.append(f"t{r} AS (SELECT a.best.c AS c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (r), range(1, {SIZE} + 1) g(i) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM t{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (c))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '-')) AS h, x FROM v ORDER BY h, x LIMIT {K})),
{",\n".join(steps)},
e AS (SELECT v.vec_id, a.best.c::INTEGER AS cluster, a.best.d::BIGINT AS distance FROM v JOIN a{ROUNDS} a USING (r)),
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM e GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance) FROM e)::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM e JOIN i USING (cluster) JOIN c{ROUNDS} f ON f.c = e.cluster"""


SQL = _sql()
