"""Finding the venue that a name means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenceloom.functions.geo import SAME_PLACE_M, distance_m
from evidenceloom.functions.similarity import extent_similarity, jaccard, word_trigram_run, word_trigrams
from evidenceloom.functions.text import collapse, is_distinctive, is_generic_location

THRESHOLD = 0.55


def resolve(names: DataFrame, venues: DataFrame) -> DataFrame:
    """name, venue_id and how (generic, exact, fuzzy, new) of each distinct name.

    names: name, lat, lon. venues: venue_id, name, aliases, lat, lon. A generic place has no venue. An exact name or alias wins (smallest id).
    Else the best venue counts, by trigrams of words: the larger of how similar both are as a whole and how similar either is to the best continuous part of
    the other. It is taken if the whole reaches 0.55, or a part does and the shorter name is distinctive; and refused where both places
    are known and further apart than 300 m. Any score of 0.55 needs so much of one name's trigrams in common, so one of its 45 % rarest must be: candidates come
    from equi-joins of each side's rarest trigrams with all of the other's, and common trigrams meet nobody. A new name's venue is itself.
    """
    wanted = names.select(collapse(F.col("name")).alias("name"), "lat", "lon").where("name != ''").groupBy("name").agg(F.min_by(F.struct("lat", "lon"), F.struct(F.col("lat").isNull(), "lat", "lon")).alias("p")).select("name", "p.lat", "p.lon", F.lower("name").alias("low"))
    known = venues.select("venue_id", F.col("name").alias("v_name"), "aliases", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    called = known.select("venue_id", F.explode(F.array_union(F.array("v_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("called")).select(F.lower(collapse(F.col("called"))).alias("low"), "venue_id").groupBy("low").agg(F.min("venue_id").alias("exact"))
    named = wanted.join(called, "low", "left").withColumn("generic", is_generic_location(F.col("name")))
    open_ = named.where("exact is null and not generic").withColumns({"grams": word_trigrams(F.col("name")), "run": word_trigram_run(F.col("name"))})
    grams = known.withColumns({"v_grams": word_trigrams(F.col("v_name")), "v_run": word_trigram_run(F.col("v_name"))})
    theirs = grams.select("venue_id", F.explode("v_grams").alias("g"))
    ours = open_.select("name", F.explode("grams").alias("g"))
    often = theirs.groupBy("g").agg(F.count("*").alias("df"))
    both = _rarest(ours, "name", often).join(theirs, "g").select("name", "venue_id").union(ours.join(_rarest(theirs, "venue_id", often), "g").select("name", "venue_id")).distinct()
    pairs = both.join(open_, "name").join(grams, "venue_id").where(F.size(F.array_intersect("grams", "v_grams")) >= THRESHOLD * F.least(F.size("grams"), F.size("v_grams")))
    shorter = F.when(F.length("name") <= F.length("v_name"), F.col("name")).otherwise(F.col("v_name"))
    pairs = pairs.withColumns({"whole": jaccard(F.col("grams"), F.col("v_grams")), "part": F.greatest(extent_similarity(F.col("v_grams"), F.col("run")), extent_similarity(F.col("grams"), F.col("v_run")))})
    far = F.coalesce(distance_m(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon")) > SAME_PLACE_M, F.lit(False))
    good = ((F.col("whole") >= THRESHOLD) | ((F.col("part") >= THRESHOLD) & is_distinctive(shorter))) & ~far
    best = pairs.groupBy("name").agg(F.max_by(F.struct("venue_id", good.alias("good")), F.struct(F.greatest("whole", "part"), -F.col("venue_id"))).alias("b")).where("b.good").select("name", F.col("b.venue_id").alias("fuzzy"))
    out = named.join(best, "name", "left")
    how = F.when(F.col("generic"), "generic").when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("new")
    return out.select("name", F.when(~F.col("generic"), F.coalesce("exact", "fuzzy")).alias("venue_id"), how.alias("how"))


def _rarest(rows: DataFrame, key: str, often: DataFrame) -> DataFrame:
    """Of each key's trigrams the rarest, so many that the rest is less than what similar names have in common."""
    w = Window.partitionBy(key)
    counted = rows.join(often, "g", "left").withColumns({"n": F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "g")), "size": F.count("*").over(w)})
    return counted.where(F.col("n") <= F.floor((1 - THRESHOLD) * F.col("size")) + 1).select(key, "g")


def reconcile(pairs: DataFrame) -> DataFrame:
    """Proposals from merges across venues (name_a, name_b, lat_a, ...): an alias where both are known, within 300 m, and the name is a venue's; else a note for review."""
    near = distance_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) < SAME_PLACE_M
    named = (F.coalesce("name_b", F.lit("")) != "") & ~is_generic_location(F.col("name_b"))
    return pairs.withColumn("proposal", F.when(F.coalesce(near & named, F.lit(False)), "alias").otherwise("review"))
