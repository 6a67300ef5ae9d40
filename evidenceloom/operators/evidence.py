"""Fusing what several sources say: newest claims, confidence, fields, status, tags, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(claims: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order, which must be total (the planner prunes before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def held(value: Column) -> Column:
    """A source's largest value, up to 0.999999; of rows or of what parts of them gave."""
    return F.max(F.least(value, F.lit(0.999999)))


def any_of(v: Column) -> Column:
    """1 - product of (1 - v) over rows."""
    return 1 - F.exp(F.sum(F.log1p(-v)))


def noisy_or(claims: DataFrame, key: list[str], source: str, value: Column) -> DataFrame:
    """1 - product of (1 - v) over sources, v a source's largest value; two aggregations with partial sums, values up to 0.999999."""
    per_source = claims.groupBy(*key, source).agg(held(value).alias("v"))
    return per_source.groupBy(*key).agg(any_of(F.col("v")).alias("confidence"), F.count("*").alias("n_sources"))


def merge_fields(fields: DataFrame, key: list[str], field: str = "field", value: str = "value", weight: str = "weight", claim: str = "claim_id", prefer_long: tuple[str, ...] = ("title", "url"), unknown: tuple[str, ...] = ()) -> DataFrame:
    """The best claim's value for each field: largest weight, then the longer text for some fields, then the larger claim id; with its claim as provenance. Claims without a value say nothing, but for the fields ``unknown``, where none is the best claim's word too."""
    length = F.when(F.col(field).isin(*prefer_long), F.length(value)).otherwise(0)
    best = F.max_by(F.struct(value, claim, weight), F.struct(F.col(weight), length, F.col(claim)))
    said = F.col(value).isNotNull() | F.col(field).isin(*unknown) if unknown else F.col(value).isNotNull()
    return fields.where(said).groupBy(*key, field).agg(best.alias("b")).select(*key, field, f"b.{value}", f"b.{claim}", f"b.{weight}")


def merge_status(claims: DataFrame, key: list[str], trust: str = "trust", at: str = "extracted_at", claim: str = "claim_id", status: str = "status", negative: tuple[str, ...] = ("cancelled", "moved", "postponed"), least_trust: float = 0.5) -> DataFrame:
    """A trusted negative status holds until a later claim that isn't negative, of at least the holder's trust, clears it.

    Any later trusted negative takes over, so only the last one can hold, and it is cleared by the largest
    trust among later others: one aggregation for the last negative, one join, one aggregation; no ordered lists.
    """
    is_negative = F.col(status).isin(*negative)
    last = claims.where(is_negative & (F.col(trust) > least_trust)).groupBy(*key).agg(F.max_by(F.struct(status, trust, at), F.struct(at, claim)).alias("h"))
    others = claims.where(~F.coalesce(is_negative, F.lit(False)))
    cleared = others.join(last, key).where((F.col(at) > F.col(f"h.{at}")) & (F.col(trust) >= F.col(f"h.{trust}"))).select(*key).distinct()
    held = last.join(cleared, key, "left_anti").select(*key, F.col(f"h.{status}").alias("held"))
    return claims.select(*key).distinct().join(held, key, "left").select(*key, F.coalesce("held", F.lit("scheduled")).alias("status"))


def merge_tags(tags: DataFrame, key: list[str], name: str = "name", origin: str = "origin", confidence: str = "confidence") -> DataFrame:
    """A tag's largest confidence by origin, its origins and its confidence (the largest of all)."""
    per = tags.groupBy(*key, name, origin).agg(F.max(confidence).alias("c"))
    out = per.groupBy(*key, name).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(origin, "c")))).alias("origin_confidences"))
    return with_confidence(out)


def with_confidence(tags: DataFrame) -> DataFrame:
    return tags.withColumns({"origins": F.array_sort(F.map_keys("origin_confidences")), "confidence": F.array_max(F.map_values("origin_confidences"))})


def replace_origin(tags: DataFrame, key: list[str], origin: str, new: DataFrame, name: str = "name") -> DataFrame:
    """Every tag without one origin, gone if it had no other, and the new tags (with confidence) of that origin in its place."""
    kept = tags.withColumn("origin_confidences", F.map_filter("origin_confidences", lambda k, _: k != origin))
    rows = kept.select(*key, name, F.explode("origin_confidences").alias("origin", "confidence"))
    return merge_tags(rows.unionByName(new.select(*key, name, F.lit(origin).alias("origin"), "confidence")), key, name)


def moving_average(rows: DataFrame, key: list[str], order: list[Column], value: str, alpha: float, start: float = 0.0) -> DataFrame:
    """Exponential average after the last value: the sum of alpha (1-alpha)^(values after it) times each value, from start."""
    w = Window.partitionBy(*key).orderBy(*order)
    after = rows.select(*key, F.col(value).alias("x"), (F.row_number().over(w) - 1).alias("after"))
    decay = F.pow(F.lit(1 - alpha), F.col("after").cast("double"))
    return after.groupBy(*key).agg((F.sum(alpha * decay * F.col("x")) + start * F.pow(F.lit(1 - alpha), F.count("*").cast("double"))).alias("average"), F.count("*").alias("n"))


def uniqueness(claims: DataFrame, source: str, event: str) -> DataFrame:
    """Share of a source's events that no other source has."""
    pairs = claims.select(source, event).distinct()
    alone = pairs.groupBy(event).agg(F.count("*").alias("n"))
    return pairs.join(alone, event).groupBy(source).agg(F.avg((F.col("n") == 1).cast("double")).alias("uniqueness"), F.count("*").alias("n_events"))


def contract(rows: DataFrame, fields: list[str], parsed: Column, least_items: int = 1, least_present: float = 0.8, least_parsed: float = 0.9) -> DataFrame:
    """Whether an extraction keeps its contract: enough items, fields present, dates parsed."""
    shares = [F.avg(F.col(f).isNotNull().cast("double")).alias(f"has_{f}") for f in fields]
    out = rows.agg(F.count("*").alias("n_items"), F.avg(F.coalesce(parsed, F.lit(False)).cast("double")).alias("parsed"), *shares)
    ok = (F.col("n_items") >= least_items) & (F.col("parsed") >= least_parsed)
    for f in fields:
        ok = ok & (F.col(f"has_{f}") >= least_present)
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))


def span(claims: DataFrame, key: list[str], at: str = "extracted_at", cadence: str = "cadence_days") -> DataFrame:
    """When each key was first and last seen, and the shortest cadence of what saw it."""
    return claims.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min(cadence).alias("cadence_days"))


def top_tags(tags: DataFrame, key: list[str], name: Column, confidence: Column, most: int = 16) -> DataFrame:
    """Each key's estimated tags by their cleaned names, the surest of each held between 0 and 1, the surest sixteen of all."""
    rows = tags.select(*key, name.alias("name"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence")).where("name is not null")
    best = rows.groupBy(*key, "name").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy(*key).orderBy(F.col("confidence").desc(), "name")
    return best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
