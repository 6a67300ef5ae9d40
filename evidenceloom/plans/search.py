"""The structured query: hard filters as set logic, then preferences ranked by certainty.

A hard filter never matches an unknown value; only the default circle lets unknown places through. Occurrences are
filtered, reduced to an event's best one, scored and ordered, in one plan; nothing is ranked outside Spark.
"""

from __future__ import annotations

import base64
import dataclasses
import datetime as dt
import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenceloom.functions import geo, text, timeutil
from evidenceloom.functions.similarity import containment, near_token, trigrams
from evidenceloom.functions.stemming import stemmed
from evidenceloom.sources.scratch import written

UNKNOWN, DEFAULT_CERTAINTY, SECONDARY_WEIGHT = 0.45, 0.5, 0.1
MAX_TAGS, MAX_TAG_WORDS, MAX_TAG_LENGTH = 8, 3, 60
# Fixed values
CATEGORIES = ["music", "nightlife", "theatre", "film", "art", "culture", "sport", "community", "learning", "family", "market", "food_drink", "tech", "religion", "other"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


@dataclasses.dataclass(frozen=True)
class Attribute:
    """An audience attribute: how it compares, and its value and certainty columns."""

    kind: str  # bool, enum, at_least, at_most, range, age
    value: str
    certainty: str | None = None


#: What may be preferred or required; another attribute is one more row here.
ATTRIBUTES = {
    "age": Attribute("age", "age_lo", "age_conf"),
    "gender_split_min": Attribute("at_least", "gender", "gender_conf"),
    "kid_friendly": Attribute("bool", "kid_friendly", "kid_friendly_conf"),
    "newcomer_friendly": Attribute("bool", "newcomer_friendly", "newcomer_friendly_conf"),
    "outdoor": Attribute("bool", "outdoor", "outdoor_conf"),
    "solo_friendly": Attribute("bool", "solo_friendly", "solo_friendly_conf"),
    "sex_service_context": Attribute("bool", "sex_service_context", "sex_service_context_conf"),
    "interaction_structure": Attribute("enum", "interaction_structure"),
    "energy": Attribute("enum", "energy"),
    "language": Attribute("enum", "language", "language_conf"),
    "price": Attribute("at_most", "price_estimate", "price_conf"),
    "event_scale": Attribute("range", "attendance", "attendance_conf"),
}
NOT_REQUIRABLE = {"price", "tags"}


@dataclasses.dataclass(frozen=True)
class Filters:
    """What a query may state; None or empty: nothing."""

    from_: dt.datetime | None = None
    to: dt.datetime | dt.date | None = None
    weekdays: tuple[str, ...] = ()
    near: tuple[float, float] | None = None
    radius: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    category: tuple[str, ...] = ()
    exclude_category: tuple[str, ...] = ()
    exclude_terms: tuple[str, ...] = ()
    name: str | None = None
    organizer: str | None = None
    venue: str | None = None
    source: str | None = None
    is_free: bool | None = None
    max_price: float | None = None
    min_confidence: float | None = None
    tags: tuple[str, ...] = ()
    min_tag_match: float | None = None
    required: tuple[str, ...] = ()
    wanted: Mapping[str, object] = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        for d in self.weekdays:
            if d not in WEEKDAYS:
                raise ValueError(f"{d} is no weekday")
        for c in (*self.category, *self.exclude_category):
            if c not in CATEGORIES:
                raise ValueError(f"{c} is no category")
        for a in self.wanted:
            if a not in ATTRIBUTES:
                raise ValueError(f"{a} is no attribute")
        for a in self.required:
            if a not in ATTRIBUTES or a in NOT_REQUIRABLE:
                raise ValueError(f"{a} can't be required")
        if self.min_tag_match is not None and not (self.tags and 0 <= self.min_tag_match <= 1):
            raise ValueError("min_tag_match needs tags and a share")
        if len(self.tags) > MAX_TAGS:
            raise ValueError(f"at most {MAX_TAGS} tags")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence is a share")
        if self.max_price is not None and self.max_price < 0:
            raise ValueError("max_price is negative")
        if self.near and not (-90 <= self.near[0] <= 90 and -180 <= self.near[1] <= 180):
            raise ValueError("near is no place")
        if self.from_ and self.to and self.until() < self.from_:
            raise ValueError("to is before from_")
        self.radius_m()

    def radius_m(self) -> float | None:
        """Metres; None for any or no radius."""
        if self.radius in (None, "any"):
            return None
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(km|m)?\s*", self.radius)
        if not m:
            raise ValueError("radius is like 5km, 500m or any")
        return float(m[1]) * (1 if m[2] == "m" else 1000)

    def until(self) -> dt.datetime | None:
        """A bare date means the end of that day."""
        return dt.datetime.combine(self.to, dt.time(23, 59, 59)) if type(self.to) is dt.date else self.to


def desired(names: list[str]) -> tuple[str, ...]:
    """What a query may want of tags: lower case, white space collapsed, each once in the order given; an error if one is no tag's name or there are too many."""
    out: dict[str, None] = {}
    for name in names:
        clean = " ".join(name.lower().split())
        if not clean or len(clean) > MAX_TAG_LENGTH or len(clean.split()) > MAX_TAG_WORDS or re.search(r"[()\n]", name):
            raise ValueError(f"{name!r} is no tag: one to {MAX_TAG_WORDS} words and at most {MAX_TAG_LENGTH} characters")
        out[clean] = None
    if len(out) > MAX_TAGS:
        raise ValueError(f"at most {MAX_TAGS} tags")
    return tuple(out)


def overlaps_window(starts: Column, ends: Column, begin: Column, until: Column | None) -> Column:
    out = F.coalesce(ends, starts) >= begin
    return out if until is None else out & (starts <= until)


def located(f: Filters, lat: Column, lon: Column) -> Column | None:
    """A circle that was asked for needs a known place; the default one does not."""
    if f.near or f.radius_m() is not None:
        return geo.within(lat, lon, f.near or geo.CENTER, f.radius_m() or geo.NEAR_RADIUS_M) if f.radius != "any" else None
    return None if f.radius == "any" or f.bbox else geo.default_gate(lat, lon)


def hard(rows: DataFrame, f: Filters, now: Column, statuses: str = "scheduled", tags: DataFrame | None = None, sources: DataFrame | None = None, hide_sensitive: bool = False) -> DataFrame:
    """Rows (occurrence with event and venue) that the filters allow; cheap predicates first, tags and sources by joins.

    statuses: ``scheduled`` for queries; ``listed`` for listings, which keep moved and postponed rows.
    """
    c = F.col
    begin = F.lit(f.from_).cast("timestamp") if f.from_ else now
    where = [c("status") == "scheduled" if statuses == "scheduled" else c("status") != "cancelled", overlaps_window(c("starts_at"), c("ends_at"), begin, F.lit(f.until()).cast("timestamp") if f.to else None)]
    if f.weekdays:
        where.append(timeutil.iso_weekday(c("starts_at")).isin(*(WEEKDAYS.index(d) + 1 for d in f.weekdays)))
    if (gate := located(f, c("lat"), c("lon"))) is not None:
        where.append(gate)
    if f.bbox:
        where.append(geo.in_box(c("lat"), c("lon"), *f.bbox))
    if f.category:
        where.append(F.arrays_overlap("category", F.array(*map(F.lit, f.category))))
    if f.exclude_category:
        where.append(~F.coalesce(F.arrays_overlap("category", F.array(*map(F.lit, f.exclude_category))), F.lit(False)))
    for term in f.exclude_terms:
        like = f"%{term}%"
        where.append(~(F.coalesce(c("title").ilike(like), F.lit(False)) | F.coalesce(c("venue_name").ilike(like), F.lit(False)) | F.coalesce(c("organizer").ilike(like), F.lit(False))))
    if f.name:
        where.append(c("title").rlike(text.compound_name_pattern(f.name)))
    for column, value in (("organizer", f.organizer), ("venue_name", f.venue)):
        if value:
            where.append(c(column).ilike(f"%{value}%"))
    if f.is_free:
        where.append(c("price_min") == 0)
    elif f.max_price is not None:
        where.append(c("price_min") <= f.max_price)
    if hide_sensitive:
        where.append(~c("sex_service_context").eqNullSafe(True))
    if f.min_confidence is not None:
        where.append(c("effective_confidence") >= f.min_confidence)
    where += [matches(n, f.wanted[n]) for n in f.required if n in f.wanted]
    for w in where:
        rows = rows.where(w)
    if f.source:
        like = f"%{f.source}%"
        ok = sources.where((c("name").ilike(like) | c("url").ilike(like)) & (c("source_status") != "internal")).select("event_id").distinct()
        rows = rows.join(ok, "event_id", "left_semi")
    if tags is not None and f.exclude_terms:
        named = tags.where(F.reduce(F.array(*(c("name").ilike(f"%{t}%") for t in f.exclude_terms)), F.lit(False), lambda a, x: a | x)).select("event_id").distinct()
        rows = rows.join(named, "event_id", "left_anti")
    return rows


def matches(name: str, want) -> Column:
    """Whether an attribute has the wanted value; null if unknown."""
    a = ATTRIBUTES[name]
    v = F.col(a.value)
    if a.kind == "age":
        return F.when(F.col("age_lo").isNotNull() & F.col("age_hi_excl").isNotNull(), (F.lit(want[0]) <= F.col("age_hi_excl") - 1) & (F.lit(want[1]) >= F.col("age_lo")))
    if a.kind == "range":
        low, high = want
        return F.when(v.isNotNull(), F.lit(True) & (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True)))
    return {"at_least": v >= want, "at_most": v <= want}.get(a.kind, v == F.lit(want))


def satisfaction(name: str, want) -> Column:
    """Probability that the wish is met: 0.5 + c/2 on a match, 0.5 - c/2 on a contradiction, a little under one half if unknown."""
    a = ATTRIBUTES[name]
    c = F.coalesce(F.col(a.certainty), F.lit(DEFAULT_CERTAINTY)).cast("double") if a.certainty else F.lit(DEFAULT_CERTAINTY)
    if a.kind == "age":
        c = F.when(c == 0, DEFAULT_CERTAINTY).otherwise(c)
    ok = matches(name, want)
    return F.when(ok.isNull(), UNKNOWN).when(ok, 0.5 + c / 2).otherwise(0.5 - c / 2)


def score(f: Filters, importance: Mapping[str, float] | None = None, tag_match: Column | None = None) -> Column:
    """Mean satisfaction of the wishes that aren't required, weighted by importance; without any, the event's own confidence."""
    importance = importance or {}
    default = SECONDARY_WEIGHT if f.tags else 1.0
    parts = [(importance.get(n, default), satisfaction(n, w)) for n, w in f.wanted.items() if n not in f.required]
    if f.tags:
        parts.append((importance.get("tags", 1.0), F.coalesce(tag_match, F.lit(0.0))))
    parts = [(w, s) for w, s in parts if w > 0]
    if not parts:
        return F.coalesce(F.col("confidence"), F.lit(0.0))
    total = sum(w for w, _ in parts)
    return sum((w * s for w, s in parts[1:]), parts[0][0] * parts[0][1]) / total


def best_occurrence(rows: DataFrame, begin: Column) -> DataFrame:
    """An event's first occurrence that begins in the window, else the one that goes on."""
    w = Window.partitionBy("event_id").orderBy((F.col("starts_at") < begin), "starts_at", "occurrence_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run(rows: DataFrame, f: Filters, now: Column, importance: Mapping[str, float] | None = None, distinct: bool = True, sort: str = "match", limit: int | None = None, offset: int = 0, tag_scores: DataFrame | None = None, tags: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Eligible rows with match_score and tag_match, best first (or by time), and a slice of them."""
    begin = F.lit(f.from_).cast("timestamp") if f.from_ else now
    found = hard(rows, f, now, tags=tags, sources=sources)
    if distinct:
        found = best_occurrence(found, begin)
    tag_match = F.lit(None).cast("double")
    if f.tags:
        found = found.join(tag_scores.select("event_id", F.col("match").alias("tag_score")), "event_id", "left")
        tag_match = F.coalesce("tag_score", F.lit(0.0))
        if f.min_tag_match is not None:
            found = found.where(F.round(tag_match, 4) >= f.min_tag_match)
    s = score(f, importance, tag_match)
    found = found.withColumns({"_s": s, "match_score": F.round(s, 4), "tag_match": F.round(tag_match, 4), "ongoing": F.col("starts_at") < begin})
    by_match = [F.col("_s").desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("starts_at").asc_nulls_last(), F.col("event_id").cast("string")]
    found = found.orderBy(*([F.col("starts_at").asc_nulls_last(), *by_match] if sort == "starts_at" else by_match))
    if offset:
        found = found.offset(offset)
    return (found if limit is None else found.limit(limit)).drop("_s", "tag_score")


def encode_cursor(ts: dt.datetime, row_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([ts.isoformat(), str(row_id)]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[dt.datetime, str]:
    """Also the older form, time and id with a bar between."""
    if "|" in cursor:
        ts, _, row_id = cursor.partition("|")
    else:
        ts, row_id = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return dt.datetime.fromisoformat(ts), row_id


def page(rows: DataFrame, ts: str, row_id: str, after: tuple | None, limit: int) -> DataFrame:
    """The next rows by time and id after a key; the first page without one."""
    if after:
        rows = rows.where((F.col(ts) > F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(row_id) > F.lit(after[1]))))
    return rows.orderBy(ts, row_id).limit(limit)


def lexical(rows: DataFrame, words: Column, row_id: str, tokens: list[str], hit: float = 0.45, rare: float = 0.6, keep: float = 0.5) -> DataFrame:
    """row_id and score of the rows that answer the tokens, by similarity weighted by rarity; fails closed.

    A token that no row has is left out, but if over half are, nothing is found. A row needs a hit on a token with
    at least ``rare`` of the largest weight, and half of the best row's score.
    Rows are cut into words once: only words that share a trigram with a token, as any with some similarity does, are written,
    and each different one of these is compared with the tokens once, however many rows have it.
    """
    tokens = list(dict.fromkeys(tokens))
    if not tokens:
        return rows.select(row_id, F.lit(0.0).alias("score")).limit(0)
    c, places = F.col, range(len(tokens))
    grams = sorted({f"  {t} "[i : i + 3] for t in tokens for i in range(len(t) + 1)})
    shares = lambda w: F.concat(F.lit("  "), w, F.lit(" ")).rlike("|".join(map(re.escape, grams)))
    has = written(rows.select(row_id, F.explode(F.filter(F.array_distinct(words), shares)).alias("_w")), "near-words")
    different = written(has.select("_w").distinct().withColumn("_g", F.size(trigrams(c("_w")))), "near-vocabulary")
    near = different.select("_w", *(near_token(t, c("_w"), c("_g")).alias(f"s{i}") for i, t in enumerate(tokens)))
    found = written(has.join(near, "_w").groupBy(row_id).agg(*(F.max(f"s{i}").alias(f"s{i}") for i in places)), "near-rows")
    df = found.agg(*(F.count_if(c(f"s{i}") >= hit).alias(f"d{i}") for i in places)).join(F.broadcast(rows.agg(F.count("*").alias("n"))))
    live = [c(f"d{i}") > 0 for i in places]
    weight = [F.when(on, F.log((c("n") + 1) / (c(f"d{i}") + 1)) + 1).otherwise(0.0) for i, on in enumerate(live)]
    n_live = sum((on.cast("int") for on in live[1:]), live[0].cast("int"))
    df = df.select(*(w.alias(f"w{i}") for i, w in enumerate(weight)), (n_live * 2 >= len(tokens)).alias("enough"))
    total, top = sum((c(f"w{i}") for i in places[1:]), c("w0")), F.greatest(*(c(f"w{i}") for i in places), F.lit(0.0))
    strong = F.lit(False)
    for i in places:
        strong = strong | ((c(f"s{i}") >= hit) & (c(f"w{i}") > 0) & (c(f"w{i}") >= rare * top))
    value = sum((c(f"w{i}") * c(f"s{i}") for i in places), F.lit(0.0)) / total
    scored = found.join(F.broadcast(df)).where(c("enough") & strong).select(row_id, value.alias("score"))
    return scored.join(F.broadcast(scored.agg(F.max("score").alias("best")))).where(c("score") >= keep * c("best")).select(row_id, "score")


def lookup(rows: DataFrame, words: Column, row_id: str, query: str, title: str = "title", venue: str = "venue_name", starts: str = "starts_at", limit: int = 10) -> DataFrame:
    """row_id and score of the best answers to what somebody typed: by score, then start; of rows with the same title and venue, spelling aside, the best."""
    scored = rows.select(row_id, title, venue, starts).join(lexical(rows, words, row_id, stemmed(query)), row_id)
    bare = F.regexp_replace(F.lower(title), r"(?U)\W+", "")
    order = [F.col("score").desc(), F.col(starts), F.col(row_id)]
    first = Window.partitionBy(bare, F.lower(F.coalesce(venue, F.lit("")))).orderBy(*order)
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy(*order).limit(limit).select(row_id, "score")


def credible(starts: Column, ends: Column, ongoing: Column, category: Column) -> Column:
    """Whether what goes on already may be shown: it must end, and within a fortnight unless it is art or culture."""
    shown = F.coalesce(F.arrays_overlap(category, F.array(F.lit("art"), F.lit("culture"))), F.lit(False))
    short = F.unix_micros(ends.cast("timestamp")) - F.unix_micros(starts.cast("timestamp")) <= 14 * 86_400_000_000
    return ~F.coalesce(ongoing, F.lit(False)) | (ends.isNotNull() & (shown | short))


def begun_last(found: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of an order, credible ones only, those that begin in the window before those that go on."""
    c = F.col
    return found.where(credible(c("starts_at"), c("ends_at"), c("ongoing"), c("category"))).orderBy(F.coalesce("ongoing", F.lit(False)), *order).limit(limit)


def feed_only(rows: DataFrame, time_unknown: bool = True, least: int | None = None, most: int | None = None, certainty: float = 0.0) -> DataFrame:
    """What feeds filter besides: dates without a time, and bounds of attendance, which hold only for estimates that are sure enough."""
    if least is not None and most is not None and least > most:
        raise ValueError("least is over most")
    if not time_unknown:
        rows = rows.where(~F.col("time_unknown"))
    if least is not None:
        rows = rows.where((F.col("attendance") >= least) & (F.col("attendance_conf") >= certainty))
    if most is not None:
        rows = rows.where((F.col("attendance") <= most) & (F.col("attendance_conf") >= certainty))
    return rows


def recalled(hunted: DataFrame, canon: DataFrame, least: float = 0.5) -> DataFrame:
    """Hunted events (id, day, title) and whether canon (day, title) has one a day off at most with half of the words.

    Of the smaller title's words so many must be shared that one of its rarest is: each side's rarest words meet all of
    the other's on equal days, and common words meet nobody.
    """
    c = F.col
    near = canon.select(F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))).alias("day"), F.array_distinct(text.title_words(c("title"))).alias("theirs")).where(F.size("theirs") > 0).distinct()
    own = hunted.select("id", "day", F.array_distinct(text.title_words(c("title"))).alias("own")).where(F.size("own") > 0)
    often = near.select("day", F.explode("theirs").alias("w")).groupBy("day", "w").agg(F.count("*").alias("df"))

    def keys(side: DataFrame, name: str, rare: bool) -> DataFrame:
        out = side.select(*side.columns, F.explode(name).alias("w"))
        if not rare:
            return out
        w = Window.partitionBy(*side.columns).orderBy(F.coalesce("df", F.lit(0)), "w")
        needed = F.ceil(F.size(name) * least - 1e-9)
        ranked = out.join(often, ["day", "w"], "left").withColumn("_n", F.row_number().over(w))
        return ranked.where(c("_n") <= F.size(name) - needed + 1).drop("_n", "df")

    pairs = keys(own, "own", True).join(keys(near, "theirs", False), ["day", "w"]).where(F.size("own") <= F.size("theirs"))
    pairs = pairs.unionByName(keys(own, "own", False).join(keys(near, "theirs", True), ["day", "w"]).where(F.size("own") > F.size("theirs")))
    hits = pairs.where(containment(c("own"), c("theirs")) >= least).select("id").distinct().withColumn("found", F.lit(True))
    return hunted.join(hits, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
