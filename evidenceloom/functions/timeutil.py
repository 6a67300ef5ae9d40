"""Local days, decay and tolerant parsing of times."""

from __future__ import annotations

import datetime as dt
import functools
import re
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the tolerant parser; without it only the formats below are read
    from dateutil import parser as tolerant
except ImportError:
    tolerant = None

ZONE = "Europe/Vienna"
# German month names and abbreviations, and what stands for them in English
MONTHS = {
    "Jänner": "January", "Jän.": "Jan", "Februar": "February", "Feb.": "Feb", "März": "March", "Mär.": "Mar", "April": "April", "Apr.": "Apr", "Mai": "May",
    "Juni": "June", "Jun.": "Jun", "Juli": "July", "Jul.": "Jul", "August": "August", "Aug.": "Aug", "September": "September", "Sept.": "Sep", "Sep.": "Sep",
    "Oktober": "October", "Okt.": "Oct", "November": "November", "Nov.": "Nov", "Dezember": "December", "Dez.": "Dec",
}
_MONTH = re.compile("|".join(re.escape(m) + ("" if m.endswith(".") else r"(?![a-zäöüß])") for m in MONTHS))
#: What most sources write, parsed without leaving the JVM.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of an instant."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def iso_weekday(ts: Column, zone: str = ZONE) -> Column:
    return F.weekday(local(ts, zone)) + 1


def local_trunc(unit: str, ts: Column, zone: str = ZONE) -> Column:
    """The instant at which the local day, week or month began."""
    return F.to_utc_timestamp(F.date_trunc(unit, local(ts, zone)), zone)


def has_time(ts: Column, zone: str = ZONE) -> Column:
    """Local midnight stands for an unknown time."""
    x = local(ts, zone)
    return (F.hour(x) != 0) | (F.minute(x) != 0)


def effective_confidence(confidence: Column, confirmed: Column, now: Column, cadence_days: Column) -> Column:
    """Confidence times 0.9 for each cadence (a week if unknown) since it was confirmed, 50 at most; none without a confirmation or at a cadence of zero."""
    seconds = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(confirmed.cast("timestamp")) / 1e6
    steps = F.floor(F.try_divide(seconds, F.coalesce(cadence_days, F.lit(7)) * 86400.0))
    return confidence * F.pow(F.lit(0.9), F.coalesce(F.least(F.lit(50), F.greatest(F.lit(0), steps)), F.lit(0)).cast("double"))


@functools.lru_cache(1 << 16)
def instant(text: str, zone: str = ZONE, today: dt.date | None = None) -> dt.datetime | None:
    """The instant that a text names, local unless it has an offset; None if it names none. Of a range the left side counts.

    Months may be German. What the text leaves out is taken from today (the first of January 2000 if not given) at midnight.
    """
    s = text.strip().split(" – ", 1)[0].removesuffix(" Uhr")
    s = _MONTH.sub(lambda m: MONTHS[m[0]], s)
    try:
        if tolerant is None:
            found = dt.datetime.fromisoformat(s)
        else:
            found = tolerant.parse(s, default=dt.datetime.combine(today or dt.date(2000, 1, 1), dt.time()))
        found = found if found.tzinfo else found.replace(tzinfo=ZoneInfo(zone))
        return found.astimezone(dt.timezone.utc)
    except (ValueError, OverflowError, TypeError):
        return None


def parse_time(text: Column, zone: str = ZONE, today: dt.date | None = None) -> Column:
    """instant() of a column: the usual formats in the JVM, the others in batches."""

    @F.pandas_udf("long")
    def others(values: pd.Series) -> pd.Series:
        found = values.map(lambda t: instant(t, zone, today), na_action="ignore")
        return found.map(lambda x: None if x is None or x is pd.NaT or pd.isna(x) else int((x - _EPOCH) // _MICRO)).astype("Int64")

    usual = text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(Z|[+-]\d\d:\d\d)?)?)?$")
    with_offset = F.try_to_timestamp(F.when(usual, F.regexp_replace(text, "Z$", "+00:00")), F.lit(FORMATS[0]))
    known = F.coalesce(with_offset, *(F.to_utc_timestamp(F.try_to_timestamp(F.when(usual, text), F.lit(f)), zone) for f in FORMATS[1:]))
    return F.when(usual, known).otherwise(F.timestamp_micros(others(F.when(~usual, text))))


_EPOCH, _MICRO = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(microseconds=1)


def parse_date(text: Column) -> Column:
    """An ISO date, or that of a date and time; null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def clock_minutes(text: Column) -> Column:
    """Minutes after midnight of HH:MM; 0 otherwise."""
    ok = text.rlike(r"^\s*([01]?\d|2[0-3]):[0-5]?\d\s*$")
    part = lambda i: F.try_to_number(F.regexp_extract(text, r"(\d+):(\d+)", i), F.lit("99")).cast("int")
    return F.when(ok, part(1) * 60 + part(2)).otherwise(0)


def retry_delay_s(attempts: Column) -> Column:
    return 60 * F.pow(F.lit(5), attempts - 1)


def parked_until(now: Column, kind: Column) -> Column:
    """After a daily cap five minutes into the next local day; after a monthly one the next local month; after an outage in an hour."""
    day, month = F.date_trunc("day", local(now)), F.date_trunc("month", local(now))
    return F.when(kind == "daily", F.to_utc_timestamp(day + F.expr("INTERVAL 1 DAY 5 MINUTES"), ZONE)).when(kind == "monthly", F.to_utc_timestamp(F.add_months(month, 1).cast("timestamp"), ZONE)).otherwise(now + F.expr("INTERVAL 1 HOUR"))
