"""Queries of what has a state: versions and their changes, streams with keyed state, jobs, ledgers; and of whole reading runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from evidenceloom.plans import control, search
from evidenceloom.plans.registry import query, r6, s
from evidenceloom.sources import adapters as A
from evidenceloom.sources import cascade, changelog, landing, ledger, recipes, tables
from evidenceloom.sources.scratch import lean, removed, scratch

# ---- versions and their changes

_VERSIONS = """v AS (
  SELECT 1 AS version, p_partkey AS k, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT 2, p_partkey, p_name, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT 3, p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END FROM part WHERE p_partkey % 4 <> 1)"""


def _published(spark, sf):
    """The log of three versions of the parts, and the schema of the table."""
    base = scratch(spark, "versions")
    table, k = tables.Versioned(spark, f"{base}/table"), F.col("k")
    part = A.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    dearer = part.withColumn("price", F.col("price") + F.when(k % 3 == 0, 1.0).otherwise(0.0))
    for version in (part.where(k % 5 != 0), dearer.where(k % 7 != 0), dearer.where(k % 4 != 1).withColumn("name", F.when(k % 10 != 0, F.col("name")))):
        changelog.publish(table, table.swap(version), f"{base}/log", ["k"])
    return base, part.schema


@query(f"""WITH {_VERSIONS}, o AS (SELECT version + 1 AS version, k, name, price FROM v)
SELECT version, CASE WHEN o.k IS NULL THEN 'insert' WHEN v.k IS NULL THEN 'delete' ELSE 'update' END AS op, k, v.name, round(v.price, 6) AS price FROM v FULL JOIN (SELECT * FROM o WHERE version <= 3) o USING (version, k)
WHERE o.k IS NULL OR v.k IS NULL OR v.name IS DISTINCT FROM o.name OR v.price <> o.price""")
def change_log_diff(spark, sf):
    """What each version changed: rows that came, changed and went."""
    base, schema = _published(spark, sf)
    return changelog.changes(spark, f"{base}/log", schema).select("version", "op", "k", "name", r6("price").alias("price"))


@query(f"WITH {_VERSIONS} SELECT k, name, round(price, 6) AS price FROM v WHERE version = 3")
def change_log_replay(spark, sf):
    """A stream that follows the log, in batches, copies it; replaying the copy gives the newest version."""
    base, schema = _published(spark, sf)
    changelog.follow(spark, f"{base}/log", schema, 2).writeStream.format("parquet").option("path", f"{base}/copy").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return changelog.replay(spark.read.parquet(f"{base}/copy"), ["k"]).select("k", "name", r6("price").alias("price"))


# ---- keyed state


@query(f"""WITH {A.CLAIM_SQL}, v AS (SELECT event_id, source_id, max(least(trust * confidence, 0.999999)) AS v FROM claim GROUP BY ALL), c AS (SELECT event_id, 1 - exp(sum(ln(1 - v))) AS confidence, count(*) AS n_sources FROM v GROUP BY 1),
h AS (SELECT event_id, max(struct_pack(at := extracted_at, claim := claim_id, trust := trust)) AS h FROM claim WHERE status = 'cancelled' AND trust > 0.5 GROUP BY 1),
x AS (SELECT DISTINCT event_id FROM claim JOIN h USING (event_id) WHERE status <> 'cancelled' AND extracted_at > h.at AND trust >= h.trust)
SELECT event_id, round(confidence, 6) AS confidence, n_sources, CASE WHEN h.event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM x) THEN 'cancelled' ELSE 'scheduled' END AS status FROM c LEFT JOIN h USING (event_id)""")
def streaming_state(spark, sf):
    """Confidence and status of every event from the claim log as a stream in four batches, kept as state by event: what all claims at once give."""
    from evidenceloom.streaming import claims as S
    from evidenceloom.streaming import state

    base = scratch(spark, "state")
    # dealt by orders, as their join needs it anyway: the parts of an order differ, so an event's claims come in several batches
    tasks = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = A.claims(spark, sf, deal="order", tasks=tasks).select("event_id", "source_id", "claim_id", "trust", "confidence", F.col("extracted_at").cast("timestamp").alias("extracted_at"), "status")
    with lean(spark):
        rows.write.option("compression", "zstd").parquet(f"{base}/in")
    landed = spark.read.parquet(f"{base}/in")
    stream = S.source(spark, f"{base}/in", landed.schema, -(-len(landed.inputFiles()) // 4))
    state.keep(state.fused(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    landed.scratch_path = f"{base}/in"
    removed(landed)
    return S.latest(spark, f"{base}/out", "event_id").select("event_id", r6("confidence").alias("confidence"), "n_sources", "status")


# ---- jobs, reports, ledger


@query("""WITH j AS (SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate <= TIMESTAMP '1996-06-01')
SELECT job_id, 'worker ' || (n - 1) // 5 AS worker, 1 AS attempts FROM j WHERE n <= 15""")
def claimed_jobs(spark, sf):
    """Three workers in turn take five jobs each from a versioned job table: the oldest that nobody has."""
    from evidenceloom.plans.queries import _jobs

    table = tables.Versioned(spark, scratch(spark, "jobs"))
    none = F.lit(None)
    jobs = _jobs(spark, sf)
    extra = {"worker": none.cast("string"), "attempts": F.lit(0), "started_at": none.cast("timestamp_ntz")}
    table.swap(jobs.withColumns({n: c for n, c in extra.items() if n not in jobs.columns}))
    now = F.lit("1996-06-01").cast("timestamp_ntz")
    for w in range(3):
        control.claim_jobs(table, f"worker {w}", now, 5)
    return table.read().where("worker is not null").select("job_id", "worker", "attempts")


@query("""WITH f AS (SELECT event_id AS report_id, user_id % 40 AS event_id, ts FROM events WHERE event_type = 'error' AND user_id % 40 < 35) SELECT event_id, min(ts)::VARCHAR AS run_after, count(*) AS n_reports FROM f WHERE event_id % 6 <> 0 GROUP BY 1""")
def reported_checks(spark, sf):
    """Reports of occurrences that there are bring a check of their event, unless one is waiting."""
    u = F.col("user_id") % 40
    reports = A.table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("report_id"), F.concat(F.lit("o"), u).alias("occurrence_id"), F.lit("wrong time").alias("reason"), F.col("ts").alias("said_at"))
    known = A.table(spark, sf, "events").select(u.alias("event_id")).distinct().where("event_id < 35").select(F.concat(F.lit("o"), "event_id").alias("occurrence_id"), "event_id")
    waiting = known.where("event_id % 6 = 0").select(F.lit("qa").alias("kind"), "event_id", F.lit("pending").alias("status")).unionByName(known.select(F.lit("qa").alias("kind"), "event_id", F.lit("done").alias("status")))
    return control.reported(reports, waiting, known)[1].select("event_id", s("run_after"), "n_reports")


_CHANGES = [
    ledger.Change("names in capitals", "SELECT n_nationkey, upper(n_name) AS name, n_regionkey FROM {table}"),
    ledger.Change("a place for notes", "SELECT *, CAST(NULL AS STRING) AS notes FROM {table}"),
    ledger.Change("no regions", "SELECT n_nationkey, name, coalesce(notes, 'none') AS notes FROM {table}"),
]
_HASHES = ", ".join(f"({i}, '{c.name}', '{hashlib.sha256(f'{c.name}{chr(10)}{c.query}'.encode()).hexdigest()}')" for i, c in enumerate(_CHANGES, 1))


@query(f"SELECT number, l.name AS change, sha256, n_nationkey, upper(n_name) AS name, 'none' AS notes FROM (VALUES {_HASHES}) l(number, name, sha256), nation")
def schema_ledger(spark, sf):
    """Three changes applied in two runs: the ledger beside the table that they made."""
    base = scratch(spark, "ledger")
    table, book = tables.Versioned(spark, f"{base}/table"), tables.Versioned(spark, f"{base}/ledger")
    table.swap(A.table(spark, sf, "nation"))
    ledger.migrate(spark, table, book, _CHANGES[:2])
    ledger.migrate(spark, table, book, _CHANGES)
    return ledger.state(book).select("number", F.col("name").alias("change"), "sha256").crossJoin(table.read())


# ---- reading runs


@query("""SELECT p_partkey AS doc_id, p_name AS title, 'https://x.at/e/' || p_partkey AS url, p_retailprice AS price_min, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS venue_name FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, p_type, NULL, NULL, NULL FROM part""")
def selector_records(spark, sf):
    """Items of a listing by selectors of elements, classes and attributes; one in five has no title."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit('<ul><li class="row big"><h3>'), F.when(k % 5 == 0, " ").otherwise(F.col("p_name")), F.lit('</h3><a class="more" href="/e/'), k, F.lit('">on</a><span data-price="'), F.col("p_retailprice"), F.lit('">!</span>'),
        F.when(k % 2 == 0, F.concat(F.lit("<i id='at'>"), "p_brand", F.lit("</i>"))).otherwise(""), F.lit('</li><li class="row"><h3>'), "p_type", F.lit("</h3></li><li><h3>no row</h3></li></ul>"),
    )
    docs = A.dealt(spark, sf, "part", "p_partkey").select(k.alias("doc_id"), body.alias("body"), F.lit("https://x.at/list").alias("url"))
    found = landing.with_selectors(docs, "li.row", {"title": "h3", "url": "a.more @href", "price_min": "span[data-price] @data-price", "venue_name": "#at"})
    return found.select("doc_id", "title", "url", "price_min", "venue_name")


_KINDS = """d AS (SELECT p_partkey AS k, p_partkey % 6 AS f, p_name AS title, (DATE '2026-01-01' + (p_partkey % 300)::INT)::VARCHAR AS day FROM part)"""


@query(f"""WITH {_KINDS} SELECT k AS doc_id, ['json_api', 'jsonld', 'rss', 'ics', 'text', NULL][f + 1] AS method, [0, 4, 3, 2, 5, NULL][f + 1]::INT AS tier, CASE WHEN f < 4 THEN title END AS title, CASE WHEN f < 4 THEN day END AS starts_at,
  [0.85, 0.95, 0.9, 0.95, NULL, NULL][f + 1]::DOUBLE AS confidence, CASE WHEN f = 4 THEN title || repeat(' and what else there is', 6) END AS said FROM d WHERE f < 5""")
def cascade_records(spark, sf):
    """Documents of six kinds in one pass, each by the first reader that finds something: JSON with a page's markup in a value, a page, a feed, a calendar, words only, a shell."""
    k, t = F.col("p_partkey"), F.col("p_name")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int"))
    event = F.to_json(F.struct(F.lit("Event").alias("@type"), t.alias("name"), day.cast("string").alias("startDate")))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), event, F.lit("</script></html>"))
    body = (
        F.when(k % 6 == 0, F.to_json(F.struct(F.array(F.struct(t.alias("title"), day.cast("string").alias("start"), F.lit("<script type='application/ld+json'>{}</script>").alias("more"))).alias("list"))))
        .when(k % 6 == 1, page)
        .when(k % 6 == 2, F.concat(F.lit('<?xml version="1.0"?><rss xmlns:ev="http://purl.org/rss/1.0/modules/event/"><channel><item><title>'), t, F.lit("</title><ev:startdate>"), day.cast("string"), F.lit("</ev:startdate></item></channel></rss>")))
        .when(k % 6 == 3, F.concat(F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:"), t, F.lit("\nDTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"), F.lit("\nEND:VEVENT\nEND:VCALENDAR")))
        .when(k % 6 == 4, F.concat(F.lit("<html><p>"), t, F.repeat(F.lit("\n and  <b>what</b> else there is"), 6), F.lit("</p></html>")))
        .otherwise("<html><p>nothing</p></html>")
    )
    docs = A.dealt(spark, sf, "part", "p_partkey").select(k.alias("doc_id"), body.alias("body"), F.lit("https://x.at/list").alias("url"))
    return cascade.records(docs, "2026-05-02 12:00:00").select("doc_id", "method", "tier", "title", "starts_at", "confidence", "said")


#: Recipes with two listings each, whose pages lead a hundred orders further; some lead back, one recipe's pages are all the same, one's dates are none, and every recipe has its cap.
_WALK = """o AS (SELECT o_orderkey AS k, (o_orderkey % 100) // 2 AS r FROM orders), n AS (SELECT k, CASE WHEN r = 7 THEN 214 WHEN k % 13 = 0 AND k >= 700 THEN k - 400 ELSE k + 100 END AS nxt FROM o), g AS (SELECT k, nxt FROM n WHERE nxt IN (SELECT k FROM o) AND nxt <> k),
e AS (SELECT r, place, 2 * r + 100 + place AS k FROM (SELECT DISTINCT r FROM o), range(2) p(place)), w(r, place, depth, k) AS (SELECT r, place, 0, k FROM e WHERE k IN (SELECT k FROM o) UNION ALL SELECT w.r, w.place, w.depth + 1, g.nxt FROM w JOIN g USING (k) WHERE w.depth < 12 + w.r % 9),
f AS (SELECT r, k, min((depth, place)) AS v FROM w GROUP BY 1, 2), u AS (SELECT r, k, row_number() OVER (PARTITION BY r ORDER BY v) AS i FROM f), c AS (SELECT r, count(*) FILTER (i <= 12 + r % 9) AS n_pages, count(*) FILTER (i > 12 + r % 9) AS n_left FROM u GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_WALK} SELECT r AS recipe_id, n_pages, CASE WHEN r = 7 THEN 'noop' WHEN n_left > 0 THEN 'cap' ELSE 'exhausted' END AS stop, CASE WHEN r = 7 THEN 1 ELSE n_pages END AS n_items, r <> 8 AND CASE WHEN r = 7 THEN 1 ELSE n_pages END >= 2 AS ok FROM c""")
def recipe_run(spark, sf):
    """Recipes from their urls along the links to next pages, by pointer doubling, to records and a verdict: how each walk ended and whether its records hold."""
    k, r = F.col("o_orderkey"), F.floor(F.col("o_orderkey") % 100 / 2).cast("int")
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    to = F.when(r == 7, F.lit(214)).when((k % 13 == 0) & (k >= 700), k - 400).otherwise(k + 100)
    day = F.when(r == 7, "2026-01-01").when(r == 8, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    event = F.to_json(F.struct(F.lit("Event").alias("@type"), F.when(r == 7, F.lit("the same")).otherwise(F.concat(F.lit("order "), k)).alias("name"), day.alias("startDate")))
    body = F.concat(F.lit('<html><script type="application/ld+json">'), event, F.lit('</script><a class="next" href="https://x.at/a'), to, F.lit('">on</a></html>'))
    pages = orders.select(k.alias("doc_id"), F.concat(F.lit("https://x.at/a"), k).alias("url"), body.alias("body"))
    day0 = F.lit("2026-01-01").cast("date")
    found = orders.select(r.alias("recipe_id")).distinct().select("recipe_id", F.lit("https://x.at/a{n}").alias("template"), (2 * F.col("recipe_id") + 100).alias("first"), (2 * F.col("recipe_id") + 101).alias("last"), day0.alias("start"), day0.alias("stop"), F.lit(1).alias("chunk_days"), (12 + F.col("recipe_id") % 9).alias("page_cap"))
    report = recipes.run(found, pages, "a.next", cascade.records(pages, "2026-05-02 12:00:00"), least=2)[1]
    return report.select("recipe_id", "n_pages", "stop", "n_items", "ok")


# ---- pages of results


@query(f"WITH {A.AUDIENCE_SQL} SELECT event_id, starts_at::VARCHAR AS starts_at FROM audience WHERE starts_at >= TIMESTAMP '2026-01-10' AND confidence >= 0.3 ORDER BY audience.starts_at, confidence DESC, event_id::VARCHAR LIMIT 25 OFFSET 50")
def offset_page(spark, sf):
    """The third page of a search sorted by time."""
    import datetime as dt

    rows = A.audiences(spark, sf).withColumns({"starts_at": F.col("starts_at").cast("timestamp"), "ends_at": F.col("ends_at").cast("timestamp")}).where("confidence >= 0.3")
    found = search.run(rows, search.Filters(from_=dt.datetime(2026, 1, 10), radius="any"), F.lit("2026-01-10").cast("timestamp"), sort="starts_at", limit=25, offset=50)
    return found.select("event_id", s("starts_at"))


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (SELECT max((o_orderdate, o_orderkey)) FROM (SELECT o_orderdate, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 40)) ORDER BY orders.o_orderdate, o_orderkey LIMIT 40")
def cursor_page(spark, sf):
    """The page after the cursor that the first page gives."""
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    last = search.page(orders, "o_orderdate", "o_orderkey", None, 40).collect()[-1]
    ts, key = search.decode_cursor(search.encode_cursor(last.o_orderdate, last.o_orderkey))
    return search.page(orders, "o_orderdate", "o_orderkey", (ts, int(key)), 40).select("o_orderkey", s("o_orderdate"))
