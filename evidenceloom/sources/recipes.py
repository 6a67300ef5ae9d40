"""A recipe run over landed pages as one plan: from its urls along the links to next pages, to records and a verdict.

While listings are few and short, a step sends the pages where they stand to the links, which stay where they are. Else the place of a page in
its listing is found by pointer doubling: after k rounds every page knows where 2^k links lead, and every listing
its first 2^k pages; so a walk of n pages takes log2(n) rounds of equi-joins, each of which deals all links twice. A listing that links back to itself ends with
the page cap like any other.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenceloom.sources import landing
from evidenceloom.sources.scratch import SMALL_ROWS, removed, small, written

#: Walks of so many pages at most go step by step if their listings are few; each step reads the links once.
STEPS = 64


def _landed(entries: DataFrame, there: DataFrame) -> DataFrame:
    """Entries that were fetched; few entries go to the pages, not all pages to the entries."""
    found = there.select("url").join(small(entries.select("url").distinct()), "url", "left_semi").distinct()
    return entries.join(found, "url")


def _stepped(known: DataFrame, jump: DataFrame, most: int) -> DataFrame:
    """Entries and, by depth, the pages that follow them, each step one broadcast of where the listings stand."""
    steps = [known]
    for depth in range(1, most + 1):
        at = F.broadcast(steps[-1].where(F.col("page_cap") >= depth))
        last = written(jump.join(at, jump["at"] == at["url"]).select("recipe_id", "place", F.col("to").alias("url"), F.lit(depth).alias("depth"), "page_cap"), "recipe-walk")
        if last.isEmpty():
            removed(last)
            break
        steps.append(last)
    whole = written(functools.reduce(DataFrame.unionByName, steps), "recipe-walk")
    removed(*steps)
    return whole


def _doubled(known: DataFrame, jump: DataFrame, most: int) -> DataFrame:
    """The same by pointer doubling."""
    step = 1
    while step < most + 1:
        further = known.join(jump, known["url"] == jump["at"]).select("recipe_id", "place", F.col("to").alias("url"), (F.col("depth") + step).alias("depth"), "page_cap")
        longer = written(known.unionByName(further.where(F.col("depth") <= F.col("page_cap"))), "recipe-walk")
        removed(known)
        known, step = longer, 2 * step
        if step < most + 1:
            twice = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to")
            doubled = written(twice, "recipe-links")
            removed(jump)
            jump = doubled
    return known


def walk(entries: DataFrame, links: DataFrame, pages: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages in the order in which a recipe visits them, and how it ended.

    entries: recipe_id, place, url. links: url, next_url. pages: url, doc_id, body (those that were fetched). caps:
    recipe_id, page_cap. A recipe visits its entries by place, then their next pages, and so on; a page once. It ends when nothing is left
    (exhausted), at its cap with pages left (cap), or, where next pages were visited but each has the body of the page before, because
    its links lead nowhere (noop). A cycle ends its listing and is told apart (cycles).

    Gives recipe_id, place, depth, url, doc_id, number; and recipe_id, n_pages, n_left, cycles, stop.
    """
    there = pages.select("url", "doc_id", F.xxhash64("body").alias("body_hash"))
    jump = links.join(there.select(F.col("url").alias("next_url")), "next_url", "left_semi").groupBy(F.col("url").alias("at")).agg(F.min("next_url").alias("to"))
    known = _landed(entries, there).join(caps, "recipe_id").select("recipe_id", "place", "url", F.lit(0).alias("depth"), "page_cap")
    most = caps.agg(F.max("page_cap")).first()[0] or 0
    known, jump = written(known, "recipe-walk"), written(jump, "recipe-links")
    # one page beyond the cap tells whether anything was left; a listing stands at one page at a time, so no step has more rows than there are entries
    known = (_stepped if most <= STEPS and known.count() <= SMALL_ROWS else _doubled)(known, jump, most)
    # a page's first visit counts; what comes after a later one was visited after the first one too
    order = F.struct("depth", "place")
    visits = known.groupBy("recipe_id", "url").agg(F.min(order).alias("v"), F.count("*").alias("times"), F.max("page_cap").alias("page_cap"))
    rows = visits.join(there, "url").select("recipe_id", "url", "doc_id", "body_hash", "v.place", "v.depth", "times", "page_cap")
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("recipe_id").orderBy("depth", "place", "url")))
    numbered = written(numbered, "recipe-pages")
    taken = numbered.where(F.col("number") <= F.col("page_cap"))
    before = taken.select("recipe_id", F.col("place"), (F.col("depth") + 1).alias("depth"), F.col("body_hash").alias("before"))
    same = taken.where("depth > 0").join(before, ["recipe_id", "place", "depth"], "left").groupBy("recipe_id").agg(F.count("*").alias("followed"), F.count_if(F.col("body_hash").eqNullSafe(F.col("before"))).alias("same"))
    ends = numbered.groupBy("recipe_id").agg(F.count_if(F.col("number") <= F.col("page_cap")).alias("n_pages"), F.count_if(F.col("number") > F.col("page_cap")).alias("n_left"), F.count_if(F.col("times") > 1).alias("cycles"))
    stop = F.when((F.col("followed") > 0) & (F.col("followed") == F.col("same")), "noop").when(F.col("n_left") > 0, "cap").otherwise("exhausted")
    report = ends.join(same, "recipe_id", "left").select("recipe_id", "n_pages", "n_left", (F.col("cycles") > 0).alias("cycles"), stop.alias("stop"))
    return taken.select("recipe_id", "place", "depth", "url", "doc_id", "number"), report


def run(recipes: DataFrame, pages: DataFrame, selector: str, records: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Records of each recipe, one for each title and start, and its report: how the walk ended and whether the records hold.

    recipes: as page_urls() takes them, and page_cap. pages: doc_id, url, body. records: what readers found in pages (doc_id, ...), for instance by
    cascade.records(); only those of visited pages count.
    """
    entries = landing.page_urls(recipes).select("recipe_id", "place", "url")
    following = landing.next_pages(pages, selector).select("url", "next_url")
    visited, report = walk(entries, following, pages, recipes.select("recipe_id", "page_cap"))
    # records meet the few visited pages, and these bring their addresses along
    own = visited.select("recipe_id", "doc_id").join(landing.with_page_url(records, visited.select("doc_id", "url").distinct(), F.lit(False)), "doc_id")
    kept = written(landing.unique_records(own), "recipe-records")
    verdict = landing.validated(kept, least)
    none = {"n_items": F.lit(0), "ok": F.lit(False)}
    return kept, report.join(verdict, "recipe_id", "left").withColumns({n: F.coalesce(n, c) for n, c in none.items()})
