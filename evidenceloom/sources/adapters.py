"""The model's tables out of the star schema's: suppliers are sources, line items claims, the event log a crawl log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenceloom.sources.scratch import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table's rows dealt over all tasks by their key: where Python reads each row, a small file is long work, and Spark makes one task of it."""
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as DuckDB rounds: Spark rounds the decimal that a number is shown as, which differs for halves
    trust = F.round((0.35 + 0.6 * (F.col("s_acctbal") + 1000) / 11000) * 10000) / 10000
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), trust.alias("trust"))


def claims(spark: SparkSession, sf_dir: str, deal: str | None = None, tasks: int | None = None) -> DataFrame:
    """One claim for each line item; the event is a part's year, part_no its part. Sources are broadcast while they are few; the last deal is by parts, so what works by part_no needs no other.

    deal: "part" or "order", by which claims are dealt last, even where the planner sends that table to all tasks; over so many tasks, if given. Texts are made after the joins: their numbers are shorter.
    """
    whole = lambda c: F.round(c).cast("bigint")
    orders, part, source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "part").select("p_partkey", "p_name"), sources(spark, sf_dir)
    numbers = {"_year": F.year("l_shipdate"), **{f"_{x}": whole(F.col(f"l_{x}") * 100) for x in ("extendedprice", "discount", "tax")}}
    item, joined = table(spark, sf_dir, "lineitem").withColumns(numbers), {"order": orders, "part": part}
    for name in ("part", "order") if deal == "order" else ("order", "part"):
        if name == deal:
            item = item.repartition(*([tasks] if tasks else []), f"l_{name}key")
        item = item.join(joined[name], F.col(f"l_{name}key") == F.col(f"{name[0]}_{name}key"))
    item = item.join(small(source), F.col("l_suppkey") == F.col("source_id"))
    claim_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", whole(F.col("l_quantity")), "_extendedprice", "_discount", "_tax")
    return item.select(
        "source_id",
        claim_id.alias("claim_id"),
        F.col("l_partkey").alias("part_no"),
        F.concat_ws("|", "l_partkey", "_year").alias("event_id"),
        F.col("p_name").alias("title"),
        F.col("l_shipdate").alias("starts_at"),
        F.col("o_orderdate").alias("extracted_at"),
        F.round(1 - 5 * F.col("l_discount"), 6).alias("confidence"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("scheduled").alias("status"),
        F.col("l_quantity").alias("quantity"),
        "source_name",
        "trust",
    )


#: The same for DuckDB.
SOURCE_SQL = "source AS (SELECT s_suppkey AS source_id, s_name AS source_name, round(0.35 + 0.6 * (s_acctbal + 1000) / 11000, 4) AS trust FROM supplier)"
CLAIM_SQL = (
    SOURCE_SQL
    + """, claim AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, round(l_quantity)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT) AS claim_id,
    l_suppkey AS source_id, concat_ws('|', l_partkey, year(l_shipdate)) AS event_id, p_name AS title, l_shipdate AS starts_at, o_orderdate AS extracted_at,
    round(1 - 5 * l_discount, 6) AS confidence, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'scheduled' END AS status, l_quantity AS quantity, source_name, trust
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN source ON l_suppkey = source.source_id)"""
)


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k"))


LOG_SQL = "log AS (SELECT event_id, user_id AS source_id, ts, event_type AS kind, value AS amount, json_extract_string(props, '$.k')::INT AS k FROM events)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with made-up coordinates; every seventh is nowhere."""
    known = F.col("c_custkey") % 7 != 0
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.when(known, 48.1 + (F.col("c_custkey") % 400) / 1000).alias("lat"), F.when(known, 14.0 + (F.col("c_custkey") % 600) / 1000).alias("lon"))


PLACE_SQL = "place AS (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN 48.1 + (c_custkey % 400) / 1000 END AS lat, CASE WHEN c_custkey % 7 <> 0 THEN 14.0 + (c_custkey % 600) / 1000 END AS lon FROM customer)"


def audiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as events with audience attributes, some unknown."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("event_id"), k.cast("string").alias("occurrence_id"), F.col("p_name").alias("title"), F.lit("scheduled").alias("status"), ((k % 89) / 100 + 0.1).alias("confidence"),
        F.when(k % 5 != 0, F.col("p_size").cast("int")).alias("age_lo"), F.when(k % 5 != 0, (F.col("p_size") + 12).cast("int")).alias("age_hi_excl"), F.when(k % 3 != 0, (k % 10) / 10).alias("age_conf"),
        F.when(k % 4 != 0, (k % 2 == 0)).alias("kid_friendly"), F.when(k % 6 != 0, (k % 7) / 10).alias("kid_friendly_conf"),
        F.when(k % 3 != 1, F.col("p_retailprice")).alias("price_estimate"), ((k % 11) / 11).alias("price_conf"), F.when(k % 3 == 0, F.col("p_retailprice")).alias("price_min"),
        F.element_at(F.array(F.lit("calm"), F.lit("lively"), F.lit("wild")), (k % 3 + 1).cast("int")).alias("energy"),
        F.when(k % 8 != 0, (k % 700).cast("int")).alias("attendance"), ((k % 13) / 13).alias("attendance_conf"),
        F.array(F.element_at(F.array(F.lit("music"), F.lit("film"), F.lit("art"), F.lit("sport")), (k % 4 + 1).cast("int"))).alias("category"),
        F.lit(None).cast("boolean").alias("sex_service_context"), F.concat(F.lit("venue "), k % 17).alias("venue_name"), F.col("p_brand").alias("organizer"),
        (F.timestamp_add("HOUR", (k * 7 % 2000).cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))).alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"),
        F.when(k % 7 != 0, 48.1 + (k % 400) / 1000).alias("lat"), F.when(k % 7 != 0, 14.0 + (k % 600) / 1000).alias("lon"),
    )


AUDIENCE_SQL = """audience AS (
  SELECT p_partkey AS event_id, p_name AS title, (p_partkey % 89) / 100 + 0.1 AS confidence,
    CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS age_lo, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 12 END AS age_hi, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 10) / 10 END AS age_conf,
    CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 2 = 0 END AS kid_friendly, CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 7) / 10 END AS kid_conf,
    CASE WHEN p_partkey % 3 <> 1 THEN p_retailprice END AS price, (p_partkey % 11) / 11 AS price_conf, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price_min,
    ['calm', 'lively', 'wild'][p_partkey % 3 + 1] AS energy, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 700 END AS attendance, (p_partkey % 13) / 13 AS attendance_conf,
    ['music', 'film', 'art', 'sport'][p_partkey % 4 + 1] AS category, 'venue ' || (p_partkey % 17) AS venue_name, p_brand AS organizer,
    TIMESTAMP '2026-01-01 00:00:00' + to_hours((p_partkey * 7 % 2000)::INT) AS starts_at,
    CASE WHEN p_partkey % 7 <> 0 THEN 48.1 + (p_partkey % 400) / 1000 END AS lat, CASE WHEN p_partkey % 7 <> 0 THEN 14.0 + (p_partkey % 600) / 1000 END AS lon FROM part)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their title and host."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source"), title.alias("title"))


TITLE_SQL = "title AS (SELECT page_id AS doc_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)"


def vector_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tags of fifty events."""
    v = table(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") % 50).alias("event_id"), F.col("label").cast("string").alias("name"), ((F.col("vec_id") % 10 + 1) / 10.0).alias("confidence"), F.col("embedding").alias("vector"), "vec_id")


def concepts(spark: SparkSession, sf_dir: str, ids: list[int], joint: int | None = None) -> DataFrame:
    """Query concepts from single vectors; the joint phrase is -1. Their names are no tag's."""
    v = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids, *([joint] if joint is not None else [])))
    number = F.coalesce(*(F.when(F.col("vec_id") == x, i) for i, x in enumerate(ids)), F.lit(-1))
    return v.select(number.alias("concept"), F.concat(F.lit("concept "), number).alias("name"), F.col("embedding").alias("vector"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each nation, of all kinds."""
    k = F.col("n_nationkey")
    at = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(
        k.alias("rule_id"), at("weekly", "daily", "monthly_by_weekday", "once", "irregular").alias("freq"), at("MO", "TU", "WE", "TH", "FR", "SA", "SU").alias("weekday"),
        F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(-1)), (k % 4 + 1).cast("int")).alias("week_of_month"), (k % 3 + 1).cast("int").alias("interval"),
        F.date_add(F.lit("2026-02-16").cast("date"), k.cast("int")).alias("valid_from"), F.when(k % 2 == 0, F.lit("2026-04-12").cast("date")).alias("valid_until"),
        F.when(k % 3 == 0, F.array(F.lit("school_holidays"))).otherwise(F.array().cast("array<string>")).alias("except_holidays"), (k * 37 % 1440).cast("int").alias("minutes"),
        F.lit("2026-03-01").cast("date").alias("from_day"), F.lit("2026-04-26").cast("date").alias("to_day"),
    )


def holidays(spark: SparkSession) -> DataFrame:
    rows = [("school_holidays", "2026-03-28", "2026-04-06"), ("public_holidays", "2026-04-06", "2026-04-06")]
    return spark.createDataFrame(rows, "kind string, a string, b string").select("kind", F.to_date("a").alias("starts_on"), F.to_date("b").alias("ends_on"))


RULE_SQL = """rule AS (
  SELECT n_nationkey AS rule_id, ['weekly', 'daily', 'monthly_by_weekday', 'once', 'irregular'][n_nationkey % 5 + 1] AS freq, n_nationkey % 7 AS wd, [1, 2, 3, -1][n_nationkey % 4 + 1] AS nth,
    n_nationkey % 3 + 1 AS every, DATE '2026-02-16' + n_nationkey::INT AS valid_from, CASE WHEN n_nationkey % 2 = 0 THEN DATE '2026-04-12' END AS valid_until, n_nationkey % 3 = 0 AS skips, n_nationkey * 37 % 1440 AS minutes FROM nation),
day AS (SELECT unnest(generate_series(DATE '2026-03-01', DATE '2026-04-26', INTERVAL 1 DAY))::DATE AS d),
hit AS (
  SELECT rule_id, d, minutes, skips FROM rule JOIN day ON d >= valid_from AND (valid_until IS NULL OR d <= valid_until)
  WHERE CASE freq WHEN 'once' THEN d = valid_from WHEN 'daily' THEN date_diff('day', valid_from, d) % every = 0
    WHEN 'weekly' THEN isodow(d) - 1 = wd AND (date_diff('day', date_trunc('week', valid_from), date_trunc('week', d)) / 7)::INT % every = 0
    WHEN 'monthly_by_weekday' THEN isodow(d) - 1 = wd AND (year(d) * 12 + month(d) - year(valid_from) * 12 - month(valid_from)) % every = 0
      AND CASE WHEN nth > 0 THEN (day(d) - 1) // 7 + 1 ELSE -((day(last_day(d)) - day(d)) // 7 + 1) END = nth
    ELSE FALSE END)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a series for each nation: weekly or fortnightly with a day's jitter, some with a skip, some irregular."""
    k, i = F.col("n_nationkey"), F.col("i")
    step = F.when(k % 4 == 3, F.lit(5) + k % 6).when(k % 2 == 0, F.lit(7)).otherwise(F.lit(14))
    skip = F.when((k % 5 == 1) & (i >= 4), step).otherwise(0)
    day = F.date_add(F.lit("2026-01-05").cast("date"), (i * step + skip + (k * 7 + i * 3) % 2).cast("int"))
    return table(spark, sf_dir, "nation").select(k.alias("series_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), "n_nationkey").select("series_id", day.alias("day"))


CALENDAR_SQL = """step AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 3 THEN 5 + n_nationkey % 6 WHEN n_nationkey % 2 = 0 THEN 7 ELSE 14 END AS s FROM nation),
calendar AS (SELECT k AS series_id, DATE '2026-01-05' + (i * s + CASE WHEN k % 5 = 1 AND i >= 4 THEN s ELSE 0 END + (k * 7 + i * 3) % 2)::INT AS day FROM step, range(8) t(i)),
gap AS (SELECT series_id, day, date_diff('day', lag(day) OVER (PARTITION BY series_id ORDER BY day), day) AS g FROM (SELECT DISTINCT * FROM calendar)),
counted AS (SELECT series_id, count(*) AS n_dates, max(day) AS last_day,
  count(*) FILTER (abs(g - 7) <= 1) AS o7, count(*) FILTER (abs(g - 14) <= 1) AS s7, count(*) FILTER (abs(g - 14) <= 1) AS o14, count(*) FILTER (abs(g - 28) <= 1) AS s14 FROM gap GROUP BY 1),
found AS (SELECT series_id, n_dates, last_day, CASE WHEN n_dates < 3 THEN NULL WHEN o7 + s7 = n_dates - 1 AND s7 <= 1 AND o7 >= s7 THEN 7 WHEN o14 + s14 = n_dates - 1 AND s14 <= 1 AND o14 >= s14 THEN 14 END AS cadence FROM counted)"""
