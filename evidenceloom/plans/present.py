"""Shaping of rows for callers: price, scale, provenance, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale_band(participants: Column) -> Column:
    return F.when(participants < 30, "intimate").when(participants < 100, "small").when(participants < 300, "medium").when(participants < 1000, "large").when(participants < 5000, "very_large").when(participants.isNotNull(), "mass")


def scale(participants: Column, confidence: Column, low: Column, high: Column) -> Column:
    """Participants with a plausible range: widened by the uncertainty where none is given, or where a point is claimed with little certainty."""
    spread = F.greatest(F.lit(0.15), 0.5 * (1 - F.coalesce(confidence, F.lit(0.0))))
    own = low.isNotNull() & high.isNotNull() & ~((low == high) & (F.coalesce(confidence, F.lit(0.0)) < 0.5))
    least = F.greatest(F.lit(1), F.floor(participants * (1 - spread)))
    return F.struct(
        participants.alias("estimated_participants"),
        F.when(participants.isNotNull(), F.when(own, low).otherwise(least)).cast("long").alias("plausible_min"),
        F.when(participants.isNotNull(), F.when(own, high).otherwise(F.greatest(least, F.ceil(participants * (1 + spread))))).cast("long").alias("plausible_max"),
        scale_band(participants).alias("band"),
    )


def price(stated_min: Column, stated_max: Column, stated_conf: Column, est_min: Column, est_max: Column, est_conf: Column) -> Column:
    """A stated price before an estimated one; its largest value is the smallest one if it is not stated."""
    stated = stated_min.isNotNull()
    return F.struct(
        F.coalesce(stated_min, est_min).alias("min"),
        F.when(stated, F.coalesce(stated_max, stated_min)).otherwise(est_max).alias("max"),
        F.when(stated, F.coalesce(stated_conf, F.lit(0.8))).otherwise(est_conf).alias("confidence"),
        F.when(stated, "stated").when(est_min.isNotNull(), "estimated").otherwise("unknown").alias("basis"),
    )


def provenance(claims: DataFrame, event: str = "event_id") -> DataFrame:
    """The names of each event's sources, without internal ones, in order."""
    return claims.where("source_status != 'internal'").groupBy(event).agg(F.sort_array(F.collect_set("source_name")).alias("sources"))


def start_estimate(time_unknown: Column, estimate: Column) -> Column:
    """The estimated time of day, only where none is known."""
    return F.when(F.coalesce(time_unknown, F.lit(False)), estimate)


def price_page(url: Column, source_url: Column) -> Column:
    """The page that says a price: the address in the claim behind it, else its source's."""
    return F.coalesce(url, source_url)


def safe_estimates(estimates: Column) -> Column:
    """Estimates (map of name to a struct) as value and confidence, without evidence, and without those that are shown in other ways."""
    shown = F.map_filter(estimates, lambda k, _: ~k.isin("price", "event_scale", "stated_price"))
    return F.transform_values(shown, lambda _, v: F.struct(v["value"].alias("value"), v["confidence"].alias("confidence")))


def calendar(entries: DataFrame, name: str, stamp: str) -> DataFrame:
    """The text of a whole calendar around its entries (occurrence_id, vevent), lines folded at 75 bytes, a row for each entry and border: place and text.

    Rows are in the order of a sort by place, so that writing them as text needs no task that holds all.
    """
    fold = lambda c: F.array_join(F.transform(F.split(c, "\r\n"), _folded), "\r\n")
    stamped = F.replace(F.col("vevent"), F.lit("\r\nDTSTART"), F.lit(f"\r\nDTSTAMP:{stamp}\r\nDTSTART"))
    head = f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//evidenceloom//EN\r\nX-WR-CALNAME:{name}"
    body = entries.select(F.concat(F.lit("1"), F.col("occurrence_id").cast("string")).alias("place"), fold(stamped).alias("text"))
    border = entries.sparkSession.createDataFrame([("0", head), ("2", "END:VCALENDAR")], "place string, text string")
    return body.unionByName(border).orderBy("place")


def _folded(line: Column) -> Column:
    """A line of ASCII and other characters, cut so that no part is over 75 bytes (a character counts as four, if one is not ASCII)."""
    width = F.when(F.octet_length(line) == F.length(line), 74).otherwise(18)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(line) / width).cast("int") - 1)), lambda i: F.substring(line, (i * width + 1).cast("int"), width))
    return F.array_join(parts, "\r\n ")


def without_evidence(estimates: Column) -> Column:
    """Estimates (map of name to a struct) without the quoted evidence."""
    return F.transform_values(estimates, lambda _, v: v.dropFields("evidence"))


def deep_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/]+/?.+$") & ~url.rlike(r"^https?://[^/]+/?$"), F.lit(False))


def vevents(rows: DataFrame) -> DataFrame:
    """A calendar entry for each row: all day (to the exclusive next day) without a time, and marked if projected."""
    stamp = lambda c: F.date_format(c.cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, r"([\;,])", r"\\$1"), "\n", r"\\n")
    from evidenceloom.functions.timeutil import local_day

    day = local_day(F.col("starts_at"))
    date = lambda d: F.date_format(d, "yyyyMMdd")
    start = F.when(F.col("time_unknown"), F.concat(F.lit("DTSTART;VALUE=DATE:"), date(day))).otherwise(F.concat(F.lit("DTSTART:"), stamp(F.col("starts_at"))))
    last = F.greatest(day, F.coalesce(local_day(F.col("ends_at")), day))
    end = F.when(F.col("time_unknown"), F.concat(F.lit("DTEND;VALUE=DATE:"), date(F.date_add(last, 1)))).otherwise(F.concat(F.lit("DTEND:"), stamp(F.col("ends_at"))))
    title = F.concat(quoted(F.col("title")), F.when(F.col("projected"), " (projected)").otherwise(""))
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("occurrence_id")), start, end, F.concat(F.lit("SUMMARY:"), title), F.concat(F.lit("URL:"), F.col("url")), F.lit("END:VEVENT"))
    return rows.select("occurrence_id", lines.alias("vevent"))
