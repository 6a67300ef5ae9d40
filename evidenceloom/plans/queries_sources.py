"""Queries of the readers: documents are made from the star schema's rows in the shapes that sources ship, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenceloom.functions import text, timeutil
from evidenceloom.plans.registry import VIENNA, query, s
from evidenceloom.sources import adapters as A
from evidenceloom.sources import landing, tables

_DAY = "DATE '2026-01-01' + (p_partkey % 300)::INT"


def _day(k: str = "p_partkey"):
    return F.date_add(F.lit("2026-01-01").cast("date"), (F.col(k) % 300).cast("int"))


def _documents(rows, key: str, body):
    return rows.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), F.lit("https://x.at/list").alias("url"))


@query(f"""WITH p AS (SELECT *, {_DAY} AS d FROM part)
SELECT p_partkey AS doc_id, p_name AS title, d::VARCHAR AS starts_at, d::VARCHAR || 'T22:30' AS ends_at, 'About ' || p_type AS description, 'https://x.at/' || p_partkey AS url, p_retailprice AS price_min, 48.25 + (p_partkey % 100) / 1000 AS lat, 0.85::DOUBLE AS confidence FROM p
UNION ALL SELECT p_partkey, p_name || ' again', (d + 7)::VARCHAR || ' 19:00', NULL, NULL, NULL, NULL, NULL, 0.85 FROM p
UNION ALL SELECT p_partkey, p_brand, strftime(d + 8, '%d.%m.%Y'), NULL, NULL, NULL, NULL, NULL, 0.85 FROM p WHERE p_partkey % 3 = 0""")
def json_records(spark, sf):
    """Three records a document, in a list of which two or three are dated; beside it lists without dates, one within a record."""
    k, d = F.col("p_partkey"), _day()
    day = lambda n: F.date_format(F.date_add(d, n), "yyyy-MM-dd")
    noise = F.array(F.struct(F.lit("Legal").alias("Name"), F.lit(7).alias("Id")))
    one = F.to_json(F.struct(F.col("p_name").alias("Name"), day(0).alias("StartDate"), F.concat(day(0), F.lit("T22:30")).alias("EndDate"), F.concat(F.lit("<p>About <b>"), "p_type", F.lit("</b></p>")).alias("ShortDescription"), F.concat(F.lit("https://x.at/"), k).alias("Url"), F.col("p_retailprice").alias("ChepeastPrice"), (48.25 + (k % 100) / 1000).alias("Latitude"), F.lit(14.25).alias("Longitude"), F.array(F.struct(F.col("p_name").alias("name"), day(1).alias("start"))).alias("dates"), noise.alias("Categories")))
    two = F.to_json(F.struct(F.concat("p_name", F.lit(" again")).alias("eventName"), F.concat(day(7), F.lit(" 19:00")).alias("from"), F.lit(None).cast("string").alias("url")))
    three = F.to_json(F.struct(F.col("p_brand").alias("summary"), F.when(k % 3 == 0, F.date_format(F.date_add(d, 8), "dd.MM.yyyy")).otherwise("1415748758").alias("begin")))
    body = F.concat(F.lit('{"meta":{"n":3},"data":{"results":['), F.concat_ws(",", one, two, three), F.lit(']},"Categories":'), F.to_json(noise), F.lit("}"))
    found = landing.json_api(_documents(A.dealt(spark, sf, "part", "p_partkey"), "p_partkey", body))
    return found.select("doc_id", "title", "starts_at", "ends_at", "description", "url", "price_min", "lat", "confidence")


@query(f"""WITH p AS (SELECT *, {_DAY} AS d FROM part)
SELECT p_partkey AS doc_id, p_name AS title, d::VARCHAR AS starts_at, p_brand AS venue_name, 'Weg ' || p_size || ' 4020 Linz' AS address, 'https://x.at/e/' || p_partkey AS url, p_type AS organizer, p_retailprice AS price_min, p_retailprice + 5 AS price_max, 48.3::DOUBLE AS lat, 0.95::DOUBLE AS confidence FROM p WHERE p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, p_name || ' course', (d + 1)::VARCHAR, 'Saal', NULL, NULL, NULL, NULL, NULL, NULL, 0.95 FROM p WHERE p_partkey % 2 = 0""")
def jsonld_records(spark, sf):
    """Events of several types within a graph; one in four is of a type that is no event's."""
    k, d = F.col("p_partkey"), _day()
    kind = F.element_at(F.array(F.lit("Event"), F.lit("SaleEvent"), F.lit("MusicEvent"), F.lit("VisualArtsEvent")), (k % 4 + 1).cast("int"))
    place = F.struct(F.col("p_brand").alias("name"), F.struct(F.concat(F.lit("Weg "), "p_size").alias("streetAddress"), F.lit("4020").alias("postalCode"), F.lit("Linz").alias("addressLocality")).alias("address"), F.struct(F.lit("48.3").alias("latitude"), F.lit(14.2).alias("longitude")).alias("geo"))
    offer = F.array(F.struct(F.col("p_retailprice").alias("lowPrice"), (F.col("p_retailprice") + 5).alias("highPrice")))
    main = F.struct(kind.alias("@type"), F.col("p_name").alias("name"), d.cast("string").alias("startDate"), F.concat(F.lit("/e/"), k).alias("url"), place.alias("location"), offer.alias("offers"), F.struct(F.col("p_type").alias("name")).alias("organizer"))
    inner = F.when(k % 2 == 0, F.struct(F.array(F.lit("Thing"), F.lit("CourseInstance")).alias("@type"), F.concat("p_name", F.lit(" course")).alias("name"), F.date_add(d, 1).cast("string").alias("startDate"), F.lit("Saal").alias("location")))
    body = F.concat(F.lit('<html><head><script type="text/javascript">x</script><script type="application/ld+json">'), F.to_json(F.struct(F.array(main).alias("@graph"), inner.alias("about"))), F.lit("</script></head></html>"))
    found = landing.jsonld(_documents(A.dealt(spark, sf, "part", "p_partkey"), "p_partkey", body))
    return found.select("doc_id", "title", "starts_at", "venue_name", "address", "url", "organizer", "price_min", "price_max", "lat", "confidence")


@query(f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS t, event_type, user_id FROM events)
SELECT event_id AS doc_id, event_type || ', open' AS title, (CASE event_id % 4 WHEN 0 THEN t WHEN 1 THEN (t AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' WHEN 2 THEN (t AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' ELSE (date_trunc('day', t) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' END)::VARCHAR AS starts_at,
  CASE WHEN event_id % 2 = 0 THEN 'FREQ=WEEKLY;BYDAY=MO' END AS rrule_raw, 'Hall ' || user_id AS venue_name FROM e""")
def calendar_records(spark, sf):
    """A calendar for each event of the log: in UTC, in a named zone, without one, and a whole day."""
    k, t = F.col("event_id"), F.col("ts")
    stamp = F.date_format(t, "yyyyMMdd'T'HHmmss")
    start = F.when(k % 4 == 0, F.concat(F.lit("DTSTART:"), stamp, F.lit("Z"))).when(k % 4 == 1, F.concat(F.lit("DTSTART;TZID=America/New_York:"), stamp)).when(k % 4 == 2, F.concat(F.lit("DTSTART:"), stamp)).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(t, "yyyyMMdd")))
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:"), "event_type", F.lit("\\,\r\n  open")), start, F.when(k % 2 == 0, F.lit("RRULE:FREQ=WEEKLY;BYDAY=MO")), F.concat(F.lit("LOCATION:Hall "), "user_id"), F.lit("BEGIN:VALARM"), F.lit("SUMMARY:alarm"), F.lit("END:VALARM"), F.lit("END:VEVENT"), F.lit("BEGIN:VEVENT"), F.lit("SUMMARY:no date"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    found = landing.ics(_documents(A.dealt(spark, sf, "events", "event_id"), "event_id", lines))
    return found.select("doc_id", "title", timeutil.parse_time(F.col("starts_at")).cast("string").alias("starts_at"), "rrule_raw", "venue_name")


@query(f"""WITH p AS (SELECT *, ({_DAY})::TIMESTAMP + INTERVAL 10 HOUR AS t FROM part)
SELECT p_partkey AS doc_id, p_name || ' & more' AS title, 'A "quoted" ' || p_type AS description, CASE p_partkey % 5 WHEN 0 THEN 'market' WHEN 1 THEN 'theatre' WHEN 2 THEN 'community' WHEN 3 THEN 'learning' END AS category, CASE WHEN p_partkey % 2 = 0 THEN 0.0::DOUBLE END AS price_max,
  (((t) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC')::VARCHAR AS starts_at, CASE WHEN p_partkey % 3 = 0 THEN 'https://www.linztermine.at/event/' || p_partkey END AS url, 2 AS n_tags
FROM p WHERE t BETWEEN TIMESTAMP '2026-05-01 12:00:00' AND TIMESTAMP '2026-07-01 12:00:00'""")
def portal_records(spark, sf):
    k = F.col("p_partkey")
    first = F.element_at(F.array(F.lit("Märkte, Fest"), F.lit("Bühne"), F.lit("Straßenfeste"), F.lit("Bildung"), F.lit("nix")), (k % 5 + 1).cast("int"))
    at = F.concat(F.date_format(_day(), "yyyy-MM-dd"), F.lit(" 10:00:00"))
    body = F.concat(
        F.lit("<?xml version='1.0' encoding='ISO-8859-1'?><events><event"), F.when(k % 2 == 0, F.lit(" freeofcharge='1'")).otherwise(""), F.lit("><title>"), "p_name", F.lit("  &amp;amp;amp; more</title><description>&lt;p&gt;A &amp;amp;quot;quoted&amp;amp;quot; "), "p_type", F.lit("&lt;/p&gt;</description><tags><tag>"), first,
        F.lit("</tag><tag>Wandern</tag></tags><link><url>https://other.at</url></link>"), F.when(k % 3 == 0, F.concat(F.lit("<link><url>https://www.linztermine.at/event/"), k, F.lit("</url></link>"))).otherwise(""), F.lit("<date dFrom='"), at, F.lit("'/><date dFrom='broken'/></event></events>"),
    )
    found = landing.portal_xml(_documents(A.dealt(spark, sf, "part", "p_partkey"), "p_partkey", body), "2026-05-02 12:00:00")
    return found.select("doc_id", "title", "description", "category", "price_max", timeutil.parse_time(F.col("starts_at")).cast("string").alias("starts_at"), "url", F.size("tags").alias("n_tags"))


@query(f"SELECT p_partkey AS doc_id, p_name AS title, ({_DAY})::VARCHAR AS starts_at, 'https://x.at/' || p_partkey AS url, p_brand AS venue_name FROM part WHERE p_partkey % 3 <> 2")
def feed_records(spark, sf):
    """A feed's items with dates of two namespaces; one in three has only a date of publication."""
    k = F.col("p_partkey")
    date = F.when(k % 3 == 0, F.concat(F.lit("<ev:startdate>"), _day().cast("string"), F.lit("</ev:startdate><ev:location>"), "p_brand", F.lit("</ev:location>"))).when(k % 3 == 1, F.concat(F.lit("<xcal:dtstart>"), _day().cast("string"), F.lit("</xcal:dtstart><xcal:location>"), "p_brand", F.lit("</xcal:location>"))).otherwise("<startDate>2026-01-01</startDate>")
    body = F.concat(F.lit('<rss xmlns:ev="http://purl.org/rss/1.0/modules/event/" xmlns:xcal="urn:ietf:params:xml:ns:xcal"><channel><item><title>'), "p_name", F.lit("</title><link>https://x.at/"), k, F.lit("</link><pubDate>Mon, 06 Jul 2026 10:00:00 GMT</pubDate>"), date, F.lit("</item></channel></rss>"))
    return landing.rss(_documents(A.dealt(spark, sf, "part", "p_partkey"), "p_partkey", body)).select("doc_id", "title", "starts_at", "url", "venue_name")


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS f, date_trunc('day', o_orderdate) + to_minutes((180 + o_orderkey % 1200)::INT) AS t FROM orders),
l AS (SELECT k, f, CASE WHEN f IN (2, 6) THEN date_trunc('day', t) ELSE t END AS t FROM o)
SELECT k AS o_orderkey, CASE WHEN f = 5 THEN t::VARCHAR WHEN f < 7 THEN ((t AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC')::VARCHAR END AS starts_at FROM l""")
def tolerant_times(spark, sf):
    """The same times as sources write them: ISO, German, English, with an offset, as a range, and nonsense."""
    k = F.col("o_orderkey")
    t = F.timestamp_add("MINUTE", (180 + k % 1200).cast("int"), F.date_trunc("day", "o_orderdate"))
    month = F.element_at(F.array(*map(F.lit, ["Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"])), F.month(t))
    f = lambda pattern: F.date_format(t, pattern)
    shape = F.element_at(F.array(
        f("yyyy-MM-dd'T'HH:mm"), F.concat(f("d. "), month, f(" yyyy, HH:mm"), F.lit(" Uhr")), f("yyyy-MM-dd"), f("EEE, d MMMM yyyy HH:mm"), f("MMM d, yyyy h:mm a"), f("yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(f("d. "), month, f(" yyyy"), F.lit(" – 31. Dezember 1999")), F.concat(F.lit("ab und zu "), f("HH:mm")),
    ), (k % 8 + 1).cast("int"))
    return A.table(spark, sf, "orders").select("o_orderkey", timeutil.parse_time(shape).cast("string").alias("starts_at"))


@query(f"""WITH c AS (SELECT event_id, ts::TIMESTAMP AS t, {VIENNA.format("ts")} AS l, event_id % 24 AS h, event_id % 70 AS m, event_id % 3 AS d FROM events),
n AS (SELECT *, ((date_trunc('day', l) + to_hours(h::INT) + to_minutes(m::INT)) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' AS named FROM c)
SELECT event_id, (CASE WHEN d <> 2 AND m <= 59 AND (d = 1 OR abs(date_diff('second', date_trunc('second', t), named)) <= 21600) THEN named ELSE t END)::VARCHAR AS starts_at FROM n""")
def explicit_start(spark, sf):
    """A performance's own time in the description beats the doors' time; of some events only the day was known."""
    k = F.col("event_id")
    said = F.concat(F.lit("Einlass 17:00. Konzertbeginn: "), (k % 24).cast("string"), F.lit(":"), F.lpad((k % 70).cast("string"), 2, "0"), F.lit(" Uhr"))
    start = text.explicit_start(F.col("ts").cast("timestamp"), F.when(k % 3 != 2, said), k % 3 == 1)
    return A.table(spark, sf, "events").select("event_id", start.cast("string").alias("starts_at"))


_RECORD_SQL = "r AS (SELECT l_suppkey % 50 AS recipe_id, l_orderkey AS doc_id, l_returnflag || l_linestatus || (l_partkey % 20) AS title, CASE WHEN l_partkey % 11 = 0 THEN 'soon' ELSE l_shipdate::DATE::VARCHAR END AS starts_at, CASE WHEN l_quantity > 40 THEN 'https://x.at/' || l_partkey END AS url FROM lineitem)"


def _records(spark, sf):
    li = A.table(spark, sf, "lineitem")
    title = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey") % 20)
    starts = F.when(F.col("l_partkey") % 11 == 0, "soon").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    return li.select((F.col("l_suppkey") % 50).alias("recipe_id"), F.col("l_orderkey").alias("doc_id"), title.alias("title"), starts.alias("starts_at"), F.when(F.col("l_quantity") > 40, F.concat(F.lit("https://x.at/"), "l_partkey")).alias("url"), F.lit(0.85).alias("confidence"))


@query(f"""WITH {_RECORD_SQL}, p AS (SELECT DISTINCT l_orderkey AS doc_id, 'https://x.at/d' || l_orderkey AS page, CASE WHEN l_orderkey % 2 = 0 THEN 0.6 ELSE 0.5 END AS sure FROM lineitem),
j AS (SELECT recipe_id, doc_id, title, starts_at, coalesce(url, page) AS url, CASE WHEN url IS NULL THEN sure ELSE 0.85 END AS c FROM r JOIN p USING (doc_id))
SELECT recipe_id, title, starts_at, url, round(c, 6)::DOUBLE AS url_confidence FROM j QUALIFY row_number() OVER (PARTITION BY recipe_id, title, starts_at ORDER BY c DESC, doc_id, url DESC) = 1""")
def recipe_records(spark, sf):
    """What the pages of a recipe give, each record once with the surest link."""
    r = _records(spark, sf)
    pages = r.select("doc_id").distinct().withColumn("url", F.concat(F.lit("https://x.at/d"), "doc_id"))
    found = landing.unique_records(landing.with_page_url(r, pages, F.col("doc_id") % 2 == 0))
    return found.select("recipe_id", "title", "starts_at", "url", F.round("url_confidence", 6).alias("url_confidence"))


@query(f"""WITH {_RECORD_SQL}, g AS (SELECT recipe_id, count(*) AS n_items, avg(CASE WHEN starts_at <> 'soon' THEN 1.0::DOUBLE ELSE 0 END) AS parsed, avg(CASE WHEN url IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS has_url FROM r GROUP BY 1)
SELECT recipe_id, n_items, round(parsed, 6) AS parsed, round(has_url, 6) AS has_url, n_items >= 5 AND parsed >= 0.9 AND has_url >= 0.15 AS ok FROM g""")
def recipe_validation(spark, sf):
    found = landing.validated(_records(spark, sf), 5, required=("title", "url"), present=0.15)
    return found.select("recipe_id", "n_items", F.round("parsed", 6).alias("parsed"), F.round("has_url", 6).alias("has_url"), "ok")


@query("""WITH p AS (SELECT l_suppkey % 50 AS recipe_id, l_orderkey % 200 AS page, array_agg(DISTINCT l_partkey) AS prints, max(l_shipdate)::DATE AS last_day FROM lineitem GROUP BY ALL), k AS (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0),
f AS (SELECT recipe_id, page, last_day, len(list_filter(prints, lambda x: x % 9 = 0)) = 0 AS stale FROM p),
w AS (SELECT *, stale AND sum(CASE WHEN stale THEN 1 ELSE 0 END) OVER (PARTITION BY recipe_id ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 OR last_day < DATE '1992-06-01' AS stop FROM f)
SELECT recipe_id, coalesce(min(page) FILTER (stop), max(page)) AS last_page, bool_or(stop) AS stopped FROM w GROUP BY 1""")
def pages_worth_walking(spark, sf):
    """How far each listing is walked: three pages in a row that show nothing new end it, or one whose dates are all past."""
    li = A.table(spark, sf, "lineitem")
    pages = li.groupBy((F.col("l_suppkey") % 50).alias("recipe_id"), (F.col("l_orderkey") % 200).alias("page")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("prints"), F.max("l_shipdate").cast("date").alias("last_day")).withColumn("listing", F.lit("all"))
    known = A.table(spark, sf, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").cast("string").alias("print"))
    return landing.worth_following(pages, known, F.lit("1992-06-01").cast("timestamp")).select("recipe_id", "last_page", "stopped")


@query("""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS host FROM pages),
x AS (SELECT page_id, host, unnest(regexp_extract_all(nav, '<a href="([^"]*)"', 1)) AS h, unnest(range(len(regexp_extract_all(nav, '<a href="([^"]*)"', 1)))) AS i FROM n),
d AS (SELECT page_id, host || h AS link, min(i) AS i FROM x GROUP BY ALL) SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS place, link FROM d""")
def link_extract(spark, sf):
    return landing.links(A.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("body"), "url"), "nav a")


_UNESCAPE = "replace(replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&'), '&amp', '&')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_UNESCAPE.format(_UNESCAPE.format(_BARE))}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


@query("""WITH v AS (SELECT page_id AS doc_id, regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '\\s+', '  ', 'g') || CASE WHEN page_id % 3 = 0 THEN ' nowhere' ELSE '' END AS evidence FROM pages)
SELECT doc_id FROM v WHERE doc_id % 3 <> 0""")
def supported_evidence(spark, sf):
    """Quotes that stand in their pages, white space and case aside; a third were made up."""
    pages = A.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    title = F.regexp_extract("text", "<title>(.*?)</title>", 1)
    quotes = pages.select("doc_id", F.concat(F.regexp_replace(F.lower(title), r"\s+", "  "), F.when(F.col("doc_id") % 3 == 0, " nowhere").otherwise("")).alias("evidence"))
    return landing.supported(quotes, pages).select("doc_id")


@query("""SELECT page_id AS doc_id, least(round((page_id % 100) / 100, 6), 0.9) AS confidence, CASE WHEN page_id % 2 = 0 THEN '/footer-less' END AS url, CASE WHEN page_id % 5 IN (0, 1) THEN ['music', 'sport'][page_id % 5 + 1] END AS category FROM pages WHERE round((page_id % 100) / 100, 6) >= 0.3 AND page_id % 2 = 1
UNION ALL SELECT page_id, least(round((page_id % 100) / 100, 6), 0.9), url, CASE WHEN page_id % 5 IN (0, 1) THEN ['music', 'sport'][page_id % 5 + 1] END FROM (SELECT page_id, 'article' AS url FROM pages WHERE page_id % 2 = 0) WHERE round((page_id % 100) / 100, 6) >= 0.3""")
def text_verdicts(spark, sf):
    """What a model read out of pages, after the rules: links must stand in the page, categories be known, confidence between 0.3 and 0.9."""
    k = F.col("page_id")
    pages = A.table(spark, sf, "pages").select(k.alias("doc_id"), F.col("html").alias("text"))
    kinds = F.element_at(F.array(*map(F.lit, ["music", "sport", "fun", "stuff", "none"])), (k % 5 + 1).cast("int"))
    verdicts = A.table(spark, sf, "pages").select(k.alias("doc_id"), F.round((k % 100) / 100, 6).alias("confidence"), F.when(k % 2 == 0, "article").otherwise("https://made.up/x").alias("url"), kinds.alias("category"))
    return landing.from_text(verdicts, pages, ["music", "sport"])


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_totalprice AS n FROM orders), old AS (SELECT * FROM o WHERE k % 3 <> 0), new AS (SELECT k, v || '!' AS v, n + 1 AS n FROM o WHERE k % 2 = 0)
SELECT k, coalesce(new.v, old.v) AS v, round(coalesce(new.n, old.n), 6) AS n FROM old FULL JOIN new USING (k)""")
def upsert_rows(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_totalprice").alias("n"))
    new = o.where("k % 2 = 0").select("k", F.concat("v", F.lit("!")).alias("v"), (F.col("n") + 1).alias("n"))
    return tables.upsert(o.where("k % 3 <> 0"), new, ["k"], [F.col("n")]).withColumn("n", F.round("n", 6))


@query(f"""WITH {A.CLAIM_SQL}, t AS (SELECT claim_id, source_id, CASE WHEN l % 4 = 0 THEN 'Fest &amp;amp; ' || title || ' - ausverkauft' ELSE title END AS title, price / 50 AS price, starts_at FROM (SELECT *, price::BIGINT AS l FROM claim))
SELECT count(*) AS n, count(DISTINCT title) AS titles, count(price) AS priced FROM (SELECT replace(replace(title, '&amp;amp;', '&'), ' - ausverkauft', '') AS title, CASE WHEN price BETWEEN 0 AND 500 THEN price END AS price FROM t)""")
def cleaned_claims(spark, sf):
    c = A.claims(spark, sf)
    odd = F.col("price").cast("decimal(20,0)").cast("bigint") % 4 == 0
    none = F.lit(None).cast("string")
    raw = c.select(F.when(odd, F.concat(F.lit("Fest &amp;amp; "), "title", F.lit(" - ausverkauft"))).otherwise(F.col("title")).alias("title"), none.alias("description"), none.alias("venue_name"), (F.col("price") / 50).alias("price_min"), F.lit(None).cast("double").alias("price_max"))
    return landing.cleaned(raw).agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.count("price_min").alias("priced"))


@query(f"""WITH p AS (SELECT *, {_DAY} AS d FROM part), n AS (SELECT p_partkey AS doc_id, p_name AS t, d, 7 + p_partkey % 3 AS source_id FROM p)
SELECT doc_id, t AS title, (((d::TIMESTAMP + INTERVAL 19 HOUR) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC')::VARCHAR AS starts_at, 0.85::DOUBLE AS confidence, t || '|' || d::VARCHAR || '|' || round_even(48.3 * 200, 0)::BIGINT || ':' || round_even((14.2 + source_id / 100) * 133, 0)::BIGINT AS fingerprint FROM n WHERE d >= DATE '2026-03-01'""")
def records_to_claims(spark, sf):
    """From pages to claims: read, cleaned, with instants, without what is past, with the fingerprint under which the source's place is known."""
    k = F.col("p_partkey")
    record = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("  "), "p_name").alias("title"), F.concat(_day().cast("string"), F.lit("T19:00")).alias("start"))).alias("items")))
    pages = _documents(A.dealt(spark, sf, "part", "p_partkey"), "p_partkey", record).withColumns({"source_id": F.col("doc_id") % 3 + 7, "fetched_at": F.lit("2026-03-01").cast("timestamp")})
    sources = A.sources(spark, sf).where("source_id between 7 and 9").select("source_id", "source_name", "trust", F.lit(48.3).alias("lat"), (14.2 + F.col("source_id") / 100).alias("lon"))
    found = landing.claims(landing.json_api(pages), pages, sources, F.lit("2026-03-02 00:00:00").cast("timestamp"))
    return found.select("doc_id", "title", s("starts_at"), "confidence", "fingerprint")
