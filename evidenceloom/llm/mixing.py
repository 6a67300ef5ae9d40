"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled (by md5 of seed, id and the text's md5) and laid end to end, up to
REPEATS times over. A document's virtual finish time is the number of its source's words up to and with it, divided
by the source's weight. All sources' documents, sorted by finish time, are the mix, cut off at the budget: the last document is
the last one that fits whole. A source that has nothing left to give drops out and the others go on by weight, so that at virtual time
t a source has given min(REPEATS * its words, t * weight): the level t at which these sum to the budget gives the
targets, and is the same as to share out again what capped sources leave.

Nothing gathers a source in one task: equal rows are counted before anything else, a source's words are summed along
ranges of the shuffled order first, and finish times by spans of virtual time, in which every source gives words at
its own even pace.

A source's words in the mix differ from its target by less than one of its documents short of it, or by its share of what the others' unfinished documents leave.

Defined results: a null or empty text has size 0, is never taken and has no place in the mix; null is a source of its own, the last
in order; documents without an id are shuffled among the others by the null's own key; rows that are equal in id, source and text are
documents of their own, one after the other in the shuffle; an empty table gives an empty one; with no words at all, targets are 0;
further columns pass through mixed() (clashing names get a leading underscore). Weights are positive integers, REPEATS copies at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free
from .ranks import before, parts_for, ranked
from .shared import written

REPEATS = 3
SEED = 11
#: Rows of a source's range in the shuffle, and words of the mix in a span of virtual time.
RANGE_ROWS, SPAN_WORDS = 20_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Words between two spaces: what is left of a text when each word is one letter and the rest is gone.
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), _BLANKS, "")), F.lit(0)).cast("long")


def cycle(rank: Column) -> Column:
    """Weights 1, 2, 3 and again, by the sources' places in their order."""
    return (rank % 3 + 1).cast("long")


def _shuffled(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "digest"))


def level(sources: DataFrame, budget: int) -> float:
    """Virtual time at which min(REPEATS * source_size, time * weight) sum to the budget: what capped sources leave is shared out again until none is above its cap."""
    time = -1.0
    cap = F.col("source_size") * REPEATS
    while True:
        full = cap <= F.lit(time) * F.col("weight")
        r = sources.agg(F.sum(F.when(full, cap)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r.open:
            return max(time, 0.0)
        new = (budget - (r.given or 0)) / r.open
        if new <= time:
            return new
        time = new


def _keyed(docs: DataFrame, doc_id: str, source: str, text: str) -> list[Column]:
    i, s, t = (F.col(f"`{c}`") for c in (doc_id, source, text))
    return [i.alias("doc_id"), s.cast("string").alias("source"), F.md5(F.coalesce(t, F.lit(""))).alias("digest")]


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weight: Callable[[Column], Column] = cycle, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, source, digest, size, source_size, weight, target, copies, taken, finish (of the copies that are taken).

    weight: from a source's place among the sources; budget: in words, all that there are where it is None.
    """
    spark = docs.sparkSession
    keys = _keyed(docs, doc_id, source, text)
    alike = docs.select(*keys, words(F.col(f"`{text}`")).alias("size")).groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("n"))
    alike = written(alike.withColumn("turn", _shuffled(seed)), "mix-documents")
    found = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count("*").alias("n_rows"), F.max("n").alias("most"), F.sum("n").alias("n_docs"))
    # places of the sources by code point: binary order of UTF-8, null last
    found = ranked(found, [F.col("source").asc_nulls_last()], parts_for(0, 1, spark), "mix-sources")
    sources = written(found.withColumn("weight", weight(F.col("rank"))), "mix-weights")
    total = sources.agg(F.sum("source_size").alias("words"), F.sum("n_docs").alias("rows"), F.sum("weight").alias("weights"), F.max("most").alias("most")).first()
    budget = (total.words or 0) if budget is None else min(budget, REPEATS * (total.words or 0))
    time = level(sources, budget)
    target = F.least(F.col("source_size") * float(REPEATS), F.lit(time) * F.col("weight"))
    sources = sources.withColumn("target", target)

    # ranges of the shuffled order: the turn's first 60 bits, cut evenly
    at = F.conv(F.substring("turn", 1, 15), 16, 10).cast("long")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / RANGE_ROWS))
    rows = alike.join(sources, alike["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("range", F.floor(at / F.lit(float(1 << 60)) * ranges).cast("long"))
    sums = before(rows.groupBy("rank", "range").agg(F.sum(F.col("size") * F.col("n")).alias("sum")), ["rank"], "range", "sum", "before")
    first = F.expr("sum(size * n) over (partition by rank, range order by turn, doc_id, digest rows between unbounded preceding and current row) - size * n")
    laid = rows.withColumn("inside", first).join(sums.select("rank", "range", "before"), ["rank", "range"])
    # equal rows one after the other; where they are very many, other tasks make a share of them each
    laid = laid.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE_ROWS))))
    if (total.most or 0) > RANGE_ROWS:
        laid = laid.repartition(parts_for(total.rows, RANGE_ROWS, spark), "rank", "turn", "part")
    laid = laid.withColumn("i", F.explode(F.sequence(F.col("part") * RANGE_ROWS + 1, F.least("n", (F.col("part") + 1) * RANGE_ROWS)))).withColumn("end", F.col("before") + F.col("inside") + F.col("i") * F.col("size"))
    laid = written(laid.select("doc_id", "source", "digest", "size", "source_size", "rank", "weight", "target", "end"), "mix-laid")

    copies = laid.where("size > 0").select("rank", "size", "end", "source_size", "weight", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("copy"))
    copies = copies.select("rank", "size", _finish(F.col("copy")).alias("finish"))
    # in a span of virtual time all open sources together give at most span * sum of weights
    span = max(SPAN_WORDS / (total.weights or 1), time / 100_000)
    # what is far beyond the level is one span, which is looked at only if the budget reaches so far
    copies = copies.withColumn("span", F.floor(F.least(F.col("finish"), F.lit(2 * time)) / F.lit(span)).cast("long"))
    spans = written(before(copies.groupBy("span").agg(F.sum("size").alias("sum")), [], "span", "sum", "before").where(F.col("before") <= F.lit(budget)), "mix-spans")
    # what is beyond the budget for certain is not sorted
    reach = spans.agg(F.max("span")).first()[0]
    copies = copies.where(F.col("span") <= F.lit(-1 if reach is None else reach))
    upto = F.expr("sum(size) over (partition by span order by finish, rank rows between unbounded preceding and current row)")
    placed = copies.join(spans.select("span", "before"), "span").withColumn("upto", F.col("before") + upto)
    cut = placed.where(F.col("upto") <= F.lit(budget)).agg(F.max(F.struct("finish", "rank")).alias("cut")).first().cut
    finishes = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda e: _finish(e))
    last = F.struct(F.lit(cut.finish if cut else -1.0).alias("finish"), F.lit(cut.rank if cut else -1).cast("long").alias("rank"))
    taken = F.when(F.col("size") > 0, F.filter(finishes, lambda x: F.struct(x.alias("finish"), F.col("rank").alias("rank")) <= last)).otherwise(F.array().cast("array<double>"))
    out = laid.withColumn("finish", taken).withColumn("copies", F.size("finish").cast("long"))
    return out.select("doc_id", "source", "digest", "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "finish")


def _finish(copy: Column) -> Column:
    """Virtual finish time of one more pass over the source."""
    return (copy * F.col("source_size") + F.col("end")).cast("double") / F.col("weight")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weight: Callable[[Column], Column] = cycle, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, with mix_time, in the order of the mix (a global range sort)."""
    chosen = plan(docs, doc_id, source, text, weight, budget, seed).where("copies > 0")
    # rows equal in id, source and text stand for each other: their copies are put together, and one such row carries them all
    chosen = chosen.groupBy("doc_id", "source", "digest").agg(F.flatten(F.collect_list("finish")).alias("_times"), F.count("*").alias("_rows"))
    names = ["_k0", "_k1", "_k2"]
    key = [c.alias(n) for n, c in zip(names, _keyed(docs, doc_id, source, text), strict=True)]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *key)
    joined = inner.join(chosen, inner["_k0"].eqNullSafe(chosen["doc_id"]) & inner["_k1"].eqNullSafe(chosen["source"]) & (inner["_k2"] == chosen["digest"]))
    single, several = joined.where("_rows = 1"), joined.where("_rows > 1").dropDuplicates(names)
    new = free(docs, "mix_time")
    out = single.unionByName(several).select("_doc.*", F.explode("_times").alias(new))
    return out.orderBy(new)


#: The same over the table documents, for DuckDB.
SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(text, '')) AS digest, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS turn FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) AS rank, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
shares(step, t) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM sources
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - sum(CASE WHEN {REPEATS} * source_size <= t * weight THEN {REPEATS} * source_size ELSE 0 END))::DOUBLE / nullif(sum(CASE WHEN {REPEATS} * source_size <= t * weight THEN 0 ELSE weight END), 0) FROM sources)
  FROM shares WHERE t IS NOT NULL AND step < (SELECT count(*) FROM sources)),
time AS (SELECT coalesce(max(t), 0) AS t FROM shares),
laid AS (
  SELECT d.*, s.source_size, s.rank, s.weight, least({REPEATS}.0 * s.source_size, t * s.weight)::DOUBLE AS target, row_number() OVER () AS r,
    sum(size) OVER (PARTITION BY s.rank ORDER BY turn, doc_id, digest ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source, time),
copies AS (SELECT r, size, rank, (copy * source_size + upto)::DOUBLE / weight AS finish FROM laid, range(0, {REPEATS}) x(copy) WHERE size > 0),
placed AS (SELECT r, size, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
won AS (SELECT r, sum(size) AS taken FROM placed WHERE upto <= (SELECT sum(size) FROM docs) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM laid LEFT JOIN won USING (r)
"""
