"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

A text is split at ``\\n``; lines are compared without the spaces, tabs and carriage returns at their
ends. A window is three consecutive lines of which one at least has a character left. Of equal windows
anywhere in the table, the first (by document id, then text hash, then line number) stays and all later
ones go: the lines that any later window covers are removed, overlaps merged. Every line that is
removed has an equal line that stays, since each later window points at an earlier one.

Windows are compared by two 64-bit hashes. They are counted with partial aggregation, so a passage in
every document costs a row for each task; only windows that occur twice go back to their documents.

Defined results: a null text stays null and an empty one empty; texts of fewer than three lines have no
window; null ids come last; rows equal in id and text are one document and get the same
result each; further columns pass through (clashing names get a leading underscore).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import free

_LAST = 9223372036854775807
#: Goes before the lines in the second hash, which so has another seed.
_SECOND = 7046029254386353131


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_removed_lines and kept_text."""
    of, ot = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    lines = F.split(F.coalesce(ot, F.lit("")), "\n", -1)
    keys = [F.coalesce(of.cast("long"), F.lit(_LAST)).alias("k_id"), F.xxhash64(ot).alias("k_text")]
    hashes = F.transform(lines, lambda x: F.xxhash64(F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")))
    blank = F.xxhash64(F.lit(""))
    # shifted copies side by side: each line's hash is at hand without a look into an array from a lambda, which would hash all lines for each
    sides = F.arrays_zip(*(F.slice(hashes, j + 1, F.size(lines) - 2).alias(f"h{j}") for j in range(3)))
    windows = docs.where(F.size(lines) >= 3).select(*keys, F.posexplode(sides).alias("i", "w"))
    windows = windows.select("k_id", "k_text", "i", *(F.col("w").getItem(x).alias(f"h{j}") for j, x in enumerate(("h0", "h1", "h2"))))
    windows = windows.where((F.col("h0") != blank) | (F.col("h1") != blank) | (F.col("h2") != blank))
    windows = windows.select("k_id", "k_text", "i", F.xxhash64("h0", "h1", "h2").alias("a"), F.xxhash64(F.lit(_SECOND), "h2", "h0", "h1").alias("b"))
    place = F.struct("k_id", "k_text", "i")
    twice = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("a", "b", "first")
    later = windows.join(twice, ["a", "b"]).where(place > F.col("first"))
    starts = later.groupBy("k_id", "k_text").agg(F.collect_set("i").alias("s"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda i: F.array(i, i + 1, i + 2)))))
    # one mark for each line up to the last that goes
    marks = F.array_join(F.zip_with(gone, F.concat(F.array(F.lit(-1)), gone), lambda p, q: F.when(p.isNull(), "").otherwise(F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1")))), "")
    m, kept, n, n_gone = (free(docs, c) for c in ("marks", "kept_text", "n_lines", "n_removed_lines"))
    removed = starts.select(F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text"), F.split(marks, "").alias(m), F.size(gone).cast("long").alias(f"{m}_n"))
    joined = docs.join(removed, (F.coalesce(of.cast("long"), F.lit(_LAST)) == F.col("r_id")) & (F.xxhash64(ot) == F.col("r_text")), "left")
    stays = F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(m), i) == "1", F.lit(False)))
    return joined.select(
        *(docs[f"`{c}`"] for c in docs.columns),
        F.when(ot.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n),
        F.coalesce(F.col(f"{m}_n"), F.lit(0).cast("long")).alias(n_gone),
        F.when(F.col(m).isNull(), ot).otherwise(F.array_join(stays, "\n")).alias(kept),
    )


#: The same over the table documents, for DuckDB; windows are compared by their lines themselves.
SQL = r"""
WITH keyed AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS k, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, k, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM keyed WHERE text IS NOT NULL),
windows AS (
  SELECT r, k, text, i, trim(line, chr(32) || chr(9) || chr(13)) AS a,
    lead(trim(line, chr(32) || chr(9) || chr(13)), 1) OVER w AS b, lead(trim(line, chr(32) || chr(9) || chr(13)), 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY r ORDER BY i)),
firsts AS (SELECT a, b, c, min(struct_pack(k := k, i := i)) AS f FROM windows WHERE c IS NOT NULL AND a || b || c <> '' GROUP BY a, b, c),
later AS (SELECT DISTINCT r, i FROM windows JOIN firsts USING (a, b, c) WHERE struct_pack(k := windows.k, i := windows.i) > f),
gone AS (SELECT DISTINCT r, i + j AS i FROM later, (VALUES (0), (1), (2)) t(j)),
kept AS (SELECT l.r, count(*) AS n, count(g.i) AS removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS t FROM lines l LEFT JOIN gone g ON l.r = g.r AND l.i = g.i GROUP BY l.r)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(removed, 0) AS n_removed_lines, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS kept_text
FROM keyed LEFT JOIN kept USING (r)
"""
