"""Calendars: rules and their dates, cadence, projection, folding of observed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenceloom.functions.timeutil import ZONE, local_day

WEEKDAYS = {d: i for i, d in enumerate(("MO", "TU", "WE", "TH", "FR", "SA", "SU"))}
HORIZON_WEEKS, PROJECTION_WEEKS, LEAST_DATES = 8, 4, 3
CADENCES = (7, 14)
MAX_SPAN_DAYS, MAX_EXHIBITION_DAYS = 10, 370


def rule_dates(rules: DataFrame, start: str, stop: str) -> DataFrame:
    """rules with a row for each local date of its rule from column start to column stop (both inclusive).

    Columns: freq (once, daily, weekly, monthly_by_weekday, irregular), weekday (MO..SU), week_of_month, interval, valid_from
    (gives the phase of intervals), valid_until. Each rule makes at most a date for each day of the span.
    """
    days = rules.withColumn("day", F.explode(F.sequence(F.greatest(F.col(start), F.col("valid_from")), F.coalesce(F.least(F.col(stop), F.col("valid_until")), F.col(stop)))))
    number = F.coalesce(*(F.when(F.col("weekday") == d, i) for d, i in WEEKDAYS.items()))
    monday = lambda d: F.date_sub(d, F.weekday(d))
    n = F.greatest(F.col("interval"), F.lit(1))
    weeks = F.datediff(monday(F.col("day")), monday(F.col("valid_from"))) / 7
    months = F.year("day") * 12 + F.month("day") - F.year("valid_from") * 12 - F.month("valid_from")
    nth = F.floor((F.dayofmonth("day") - 1) / 7) + 1
    nth_last = -(F.floor((F.dayofmonth(F.last_day("day")) - F.dayofmonth("day")) / 7) + 1)
    ordinal = F.when(F.coalesce("week_of_month", F.lit(0)) == 0, 1).otherwise(F.col("week_of_month"))
    fits = (
        F.when(F.col("freq") == "once", F.col("day") == F.col("valid_from"))
        .when(F.col("freq") == "daily", F.pmod(F.datediff("day", "valid_from"), n) == 0)
        .when(F.col("freq") == "weekly", (F.weekday("day") == number) & (F.pmod(weeks, n) == 0))
        .when(F.col("freq") == "monthly_by_weekday", (F.weekday("day") == number) & (F.pmod(months, n) == 0) & (F.when(ordinal > 0, nth).otherwise(nth_last) == ordinal))
        .otherwise(False)
    )
    # an empty span counts backwards in sequence()
    return days.where(F.col("day").between(F.col(start), F.col(stop)) & (F.col("day") >= F.col("valid_from")) & F.coalesce(F.col("day") <= F.col("valid_until"), F.lit(True)) & F.coalesce(fits, F.lit(False)))


def without_holidays(dates: DataFrame, holidays: DataFrame, kinds: str = "except_holidays") -> DataFrame:
    """Dates that no holiday range (kind, starts_on, ends_on) of their own kinds covers. Ranges become days, so the anti-join has equal keys."""
    days = holidays.select(F.col("kind").alias("h_kind"), F.explode(F.sequence("starts_on", "ends_on")).alias("h_day")).distinct()
    return dates.join(days, (dates["day"] == days["h_day"]) & F.array_contains(dates[kinds], days["h_kind"]), "left_anti")


def local_start(day: Column, minutes: Column, zone: str = ZONE) -> Column:
    """The instant of a wall-clock time on a local day: rules are expanded in local time, so that they hold across changes of the clock."""
    return F.to_utc_timestamp(F.timestamp_add("MINUTE", minutes, day.cast("timestamp")), zone)


def cadence(dates: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """Every key's weekly or biweekly cadence in days, or null: each gap within a day of it, but one gap of twice as much."""
    w = Window.partitionBy(*key).orderBy("d")
    gaps = dates.select(*key, F.col(day).alias("d")).distinct().withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    counts = [F.count("*").alias("n_dates"), F.max("d").alias("last_day")]
    for c in CADENCES:
        counts += [F.count_if(F.abs(F.col("gap") - c) <= 1).alias(f"on_{c}"), F.count_if(F.abs(F.col("gap") - 2 * c) <= 1).alias(f"skip_{c}")]
    found = [F.when((F.col(f"on_{c}") + F.col(f"skip_{c}") == F.col("n_dates") - 1) & (F.col(f"skip_{c}") <= 1) & (F.col(f"on_{c}") >= F.col(f"skip_{c}")), c) for c in CADENCES]
    return gaps.groupBy(*key).agg(*counts).select(*key, "n_dates", "last_day", F.when(F.col("n_dates") >= LEAST_DATES, F.coalesce(*found)).alias("cadence"))


def project(series: DataFrame, edge: str) -> DataFrame:
    """series with a row for each date (projected_day) that its cadence promises, at most four weeks past the last one and after the edge of what is covered."""
    step = F.transform(F.sequence(F.lit(1), F.floor(F.lit(7 * PROJECTION_WEEKS) / F.col("cadence")).cast("int")), lambda i: F.date_add(F.col("last_day"), (i * F.col("cadence")).cast("int")))
    return series.where("cadence is not null").withColumn("projected_day", F.explode(step)).where(F.col("projected_day") > F.col(edge))


def sane_end(starts: Column, ends: Column, categories: Column) -> Column:
    """The end, unless it is before the start or too far off to be one occurrence."""
    days = F.when(F.coalesce(F.arrays_overlap(F.array_compact(categories), F.array(F.lit("art"), F.lit("culture"))), F.lit(False)), MAX_EXHIBITION_DAYS).otherwise(MAX_SPAN_DAYS)
    span = (F.unix_micros(ends.cast("timestamp")) - F.unix_micros(starts.cast("timestamp"))) / 86400e6
    return F.when((span >= 0) & (span <= days), ends)


def fold(candidates: DataFrame, key: list[str], bare_keys: DataFrame | None = None) -> DataFrame:
    """One occurrence for each instant with a known time (the shortest known end), and one for a date without time if its local day has no other.

    Columns: starts_at, ends_at, timed. Both choices are minimum aggregations. bare_keys: the keys that have a date without time, if they are known; the days of others are not looked at.
    """
    length = F.unix_micros(F.col("ends_at").cast("timestamp")) - F.unix_micros(F.col("starts_at").cast("timestamp"))
    shortest = F.min(F.when(F.col("ends_at").isNotNull(), F.struct(length.alias("l"), F.col("ends_at").alias("e"))))
    timed = candidates.where("timed").groupBy(*key, "starts_at").agg(shortest.alias("s")).select(*key, "starts_at", F.col("s.e").alias("ends_at"), F.lit(True).alias("timed"))
    beside = timed if bare_keys is None else timed.join(bare_keys, key, "left_semi")
    busy = beside.select(*key, local_day(F.col("starts_at")).alias("day")).distinct()
    bare = candidates.where("not timed").withColumn("day", local_day(F.col("starts_at"))).join(busy, [*key, "day"], "left_anti")
    first = bare.groupBy(*key, "day").agg(F.min(F.struct("starts_at", F.struct(F.col("ends_at").isNull().alias("n"), F.col("ends_at").alias("e")).alias("e"))).alias("s"))
    return timed.unionByName(first.select(*key, F.col("s.starts_at").alias("starts_at"), F.col("s.e.e").alias("ends_at"), F.lit(False).alias("timed")))


def mode(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, of equally frequent ones the smallest."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("c"))
    return counts.groupBy(*key).agg(F.max_by(value, F.struct(F.col("c"), -F.col(value))).alias("mode"))


def modes(rows: DataFrame, key: list[str], starts: str = "starts_at", ends: str = "ends_at", zone: str = ZONE) -> DataFrame:
    """Each key's most frequent wall-clock minute and, of rows with an end, duration in seconds (of equally frequent ones the smallest)."""
    local = F.from_utc_timestamp(F.col(starts).cast("timestamp"), zone)
    values = {"minutes": F.hour(local) * 60 + F.minute(local), "duration_s": F.unix_seconds(F.col(ends).cast("timestamp")) - F.unix_seconds(F.col(starts).cast("timestamp"))}
    out = rows.select(*key).distinct()
    for name, value in values.items():
        out = out.join(mode(rows.select(*key, value.cast("long").alias("_v")), key, "_v").withColumnRenamed("mode", name), key, "left")
    return out


def parse_rrule(text: Column) -> Column:
    """The parts of an iCalendar rule: freq (null if it is none that days can tell), every, until, count, days (nth, day), month_days, months, positions."""
    part = lambda k: F.regexp_extract(F.upper(text), rf"(?:^|[;:\s]){k}=([^;\s]+)", 1)
    numbers = lambda k: F.transform(F.filter(F.split(part(k), ","), lambda x: x.rlike(r"^[+-]?\d+$")), lambda x: F.regexp_replace(x, r"^\+", "").cast("int"))
    day = lambda x: F.struct(F.nullif(F.regexp_replace(F.regexp_extract(x, r"^([+-]?\d*)", 1), r"^\+", ""), F.lit("")).cast("int").alias("nth"), F.coalesce(*(F.when(F.right(x, F.lit(2)) == d, i) for d, i in WEEKDAYS.items())).alias("day"))
    days = F.transform(F.filter(F.split(part("BYDAY"), ","), lambda x: x.rlike(r"^[+-]?\d*(MO|TU|WE|TH|FR|SA|SU)$")), day)
    unknown = F.upper(text).rlike(r"(?:^|[;:\s])(BYWEEKNO|BYYEARDAY|BYHOUR|BYMINUTE|BYSECOND|BYEASTER)=")
    freq = part("FREQ")
    return F.struct(
        F.when(freq.isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY") & ~unknown, freq).alias("freq"),
        F.greatest(F.coalesce(F.when(part("INTERVAL").rlike(r"^\d+$"), part("INTERVAL").cast("int")), F.lit(1)), F.lit(1)).alias("every"),
        F.try_to_date(F.nullif(F.substring(part("UNTIL"), 1, 8), F.lit("")), "yyyyMMdd").alias("until"),
        F.when(part("COUNT").rlike(r"^\d+$"), part("COUNT").cast("int")).alias("count"),
        days.alias("days"), numbers("BYMONTHDAY").alias("month_days"), numbers("BYMONTH").alias("months"), numbers("BYSETPOS").alias("positions"),
        F.when(part("WKST").isin(*WEEKDAYS), F.coalesce(*(F.when(part("WKST") == d, i) for d, i in WEEKDAYS.items()))).otherwise(0).alias("week_start"),
    )


def rrule_dates(rules: DataFrame, key: str, rule: str, first: str, start: str, stop: str) -> DataFrame:
    """key and day: the local dates of iCalendar rules from column start to column stop (both inclusive).

    rules: key, rule (text), first (the date of DTSTART, from which intervals and counts run). Days are exploded and held against the
    rule's parts, so a rule costs a row for each day; counts and positions are ranks within a rule and within one of its periods.
    """
    c = F.col
    r = rules.select(key, c(first).alias("first"), c(start).alias("start"), c(stop).alias("stop"), parse_rrule(c(rule)).alias("r")).select(key, "first", "start", "stop", "r.*")
    r = r.where(c("freq").isNotNull() & c("first").isNotNull())
    # what was before the span matters only for counts and positions
    begin = F.when(c("count").isNotNull(), c("first")).otherwise(F.greatest("first", F.trunc("start", "year")))
    end = F.least(c("stop"), F.coalesce("until", "stop"))
    # positions count within whole periods, of which the first and last may begin before and end after the span
    ranked = F.size("positions") > 0
    whole = F.when(ranked, F.date_add(F.last_day(F.add_months(F.trunc(end, "year"), 11)), 7)).otherwise(end)
    day = r.where(begin <= end).withColumn("day", F.explode(F.sequence(F.when(ranked, F.date_sub(F.trunc(begin, "year"), 7)).otherwise(begin), whole)))
    d = c("day")
    month_end = F.last_day(d)
    in_month, left = F.dayofmonth(d), F.dayofmonth(d) - F.dayofmonth(month_end) - 1
    weekday = F.weekday(d)
    week = lambda x: F.date_sub(x, F.pmod(F.weekday(x) - c("week_start"), F.lit(7)))
    year_end = F.last_day(F.add_months(F.trunc(d, "year"), 11))
    by_year = (c("freq") == "YEARLY") & (F.size("months") == 0)
    nth = F.when(by_year, F.floor((F.dayofyear(d) - 1) / 7) + 1).otherwise(F.floor((in_month - 1) / 7) + 1).cast("int")
    nth_last = -(F.when(by_year, F.floor((F.dayofyear(year_end) - F.dayofyear(d)) / 7) + 1).otherwise(F.floor((F.dayofmonth(month_end) - in_month) / 7) + 1)).cast("int")
    counted = c("freq").isin("MONTHLY", "YEARLY")
    any_day = F.exists("days", lambda x: (x["day"] == weekday) & (x["nth"].isNull() | ~counted | (x["nth"] == nth) | (x["nth"] == nth_last)))
    no_days, no_month_days, no_months = F.size("days") == 0, F.size("month_days") == 0, F.size("months") == 0
    bare = no_days & no_month_days
    same = (
        F.when((c("freq") == "WEEKLY") & bare, weekday == F.weekday("first"))
        .when((c("freq") == "MONTHLY") & bare, in_month == F.dayofmonth("first"))
        .when((c("freq") == "YEARLY") & bare, (in_month == F.dayofmonth("first")) & (~no_months | (F.month(d) == F.month("first"))))
        .otherwise(True)
    )
    passed = (
        F.when(c("freq") == "DAILY", F.datediff(d, "first"))
        .when(c("freq") == "WEEKLY", F.datediff(week(d), week(c("first"))) / 7)
        .when(c("freq") == "MONTHLY", F.year(d) * 12 + F.month(d) - F.year("first") * 12 - F.month("first"))
        .otherwise(F.year(d) - F.year("first"))
    )
    # BYMONTHDAY of a yearly rule without BYMONTH holds in every month, as does BYDAY without a number
    fits = (F.pmod(passed, c("every")) == 0) & same & (no_days | any_day) & (no_months | F.array_contains("months", F.month(d))) & (no_month_days | F.exists("month_days", lambda x: (x == in_month) | (x == left)))
    found = day.where(fits)
    period = F.when(c("freq") == "DAILY", d).when(c("freq") == "WEEKLY", week(d)).when(c("freq") == "MONTHLY", F.trunc(d, "month")).otherwise(F.trunc(d, "year"))
    w = Window.partitionBy(key, "first", period)
    up, down = F.row_number().over(w.orderBy("day")), -F.row_number().over(w.orderBy(F.col("day").desc()))
    found = found.withColumns({"_up": up, "_down": down}).where((F.size("positions") == 0) | F.array_contains("positions", c("_up")) | F.array_contains("positions", c("_down")))
    found = found.where((d >= c("first")) & (d <= end)).withColumn("_n", F.row_number().over(Window.partitionBy(key, "first").orderBy("day")))
    return found.where((c("count").isNull() | (c("_n") <= c("count"))) & d.between(c("start"), c("stop"))).select(key, "day")
