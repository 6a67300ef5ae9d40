"""Queries of the canon: venues, rules, cleaning, grouping, identity, the whole rebuild; its stages each with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidenceloom.functions import text
from evidenceloom.operators import recurrence, venues
from evidenceloom.plans import canon
from evidenceloom.plans.registry import VIENNA, query, r6, s
from evidenceloom.sources import adapters as A
from evidenceloom.sources.scratch import written

# ---- venues


def _run(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


#: Every continuous part of the second name's run of trigrams against the first one's set.
_EXTENT = "(SELECT max(c / (len({0}) + d - c)::DOUBLE) FROM (SELECT len(list_intersect(list_distinct({1}[i:j]), {0})) AS c, len(list_distinct({1}[i:j])) AS d FROM range(1, len({1}) + 1) a(i), range(1, len({1}) + 1) b(j) WHERE i <= j))"


@query(f"""WITH v AS (SELECT min(p_partkey) AS id, CASE WHEN min(p_partkey) % 3 = 0 THEN split_part(p_name, ' ', 2) || ' hall' ELSE p_name || ' hall' END AS v, 'house ' || min(p_partkey) AS alias FROM part GROUP BY p_name),
n AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN 'HOUSE  ' || p_partkey ELSE 'The ' || p_name || ' Hall' || CASE WHEN p_partkey % 40 = 1 THEN ', ' || p_brand ELSE '' END END AS raw FROM part), m AS (SELECT DISTINCT regexp_replace(raw, ' +', ' ', 'g') AS name FROM n),
exact AS (SELECT name, min(id) AS id FROM m JOIN v ON lower(name) IN (alias, lower(v)) GROUP BY 1),
g AS (SELECT name, {_run("name")} AS nr, list_distinct(nr) AS ng FROM m WHERE name NOT IN (SELECT name FROM exact)), h AS (SELECT id, v, {_run("v")} AS vr, list_distinct(vr) AS vg FROM v),
x AS (SELECT *, len(list_intersect(ng, vg)) AS common FROM g, h WHERE common >= 0.55 * least(len(ng), len(vg))),
y AS (SELECT name, v, id, common / (len(ng) + len(vg) - common)::DOUBLE AS whole, greatest({_EXTENT.format("vg", "nr")}, {_EXTENT.format("ng", "vr")}) AS part FROM x),
best AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY name ORDER BY greatest(whole, part) DESC, id) = 1),
ok AS (SELECT name, id, list_filter(regexp_split_to_array(lower(CASE WHEN length(name) <= length(v) THEN name ELSE v END), '[^a-z0-9]+'), lambda w: length(w) >= 4) AS long FROM best WHERE whole >= 0.55 OR (part >= 0.55 AND (len(long) >= 2 OR (len(long) = 1 AND length(long[1]) >= 6))))
SELECT name, coalesce(exact.id, ok.id) AS venue_id, CASE WHEN exact.id IS NOT NULL THEN 'exact' WHEN ok.id IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS how FROM m LEFT JOIN exact USING (name) LEFT JOIN ok USING (name)""")
def venue_resolution(spark, sf):
    """Names by their aliases, by similarity of the whole, or of the best continuous part of one to the other."""
    part, k, name = A.table(spark, sf, "part"), F.col("k"), F.col("p_name")
    none = F.lit(None).cast("double")
    called = F.when(k % 3 == 0, F.concat(F.get(F.split("p_name", " "), F.lit(1)), F.lit(" hall"))).otherwise(F.concat("p_name", F.lit(" hall")))
    known = part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(k.alias("venue_id"), called.alias("name"), F.array(F.concat(F.lit("house "), k)).alias("aliases"), none.alias("lat"), none.alias("lon"))
    names = part.select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("HOUSE  "), "p_partkey")).otherwise(F.concat(F.lit("The "), name, F.lit(" Hall"), F.when(F.col("p_partkey") % 40 == 1, F.concat(F.lit(", "), "p_brand")).otherwise(""))).alias("name"), none.alias("lat"), none.alias("lon"))
    return venues.resolve(names, known)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN 'alias' ELSE 'review' END AS proposal FROM customer""")
def venue_reconcile(spark, sf):
    """Names that merges suggest: those of venues that are known and near become aliases."""
    k, p = F.col("c_custkey"), A.places(spark, sf)
    pairs = p.select(k, F.lit("Hall").alias("name_a"), F.when(k % 5 == 0, "Innenstadt").otherwise(F.concat(F.lit("Saal "), k)).alias("name_b"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), (F.col("lat") + F.when(k % 3 == 0, 0.0005).otherwise(0.5)).alias("lat_b"), F.col("lon").alias("lon_b"))
    return venues.reconcile(pairs).select("c_custkey", "proposal")


# ---- calendars' own rules

_FORMS = ["FREQ=DAILY;INTERVAL=3", "FREQ=WEEKLY;BYDAY=MO,WE,FR;INTERVAL=2", "FREQ=MONTHLY;BYDAY=2TU,-1FR", "FREQ=MONTHLY;BYMONTHDAY=1,15,-1;COUNT=9", "FREQ=YEARLY;BYMONTH=6,12;BYMONTHDAY=24", "FREQ=WEEKLY;UNTIL=20260815T120000Z;BYDAY=SA", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1"]


@query("""WITH r AS (SELECT p_partkey AS rule_id, p_partkey % 7 AS f, DATE '2026-01-01' + (p_partkey % 200)::INT AS first FROM part WHERE p_partkey % 7 < 7),
d AS (SELECT rule_id, f, first, unnest(generate_series(first, DATE '2027-03-31', INTERVAL 1 DAY))::DATE AS day FROM r),
p AS (SELECT *, isodow(day) AS wd, day(last_day(day)) AS len, day(day) AS dom FROM d),
h AS (SELECT *, CASE f WHEN 0 THEN date_diff('day', first, day) % 3 = 0 WHEN 1 THEN wd IN (1, 3, 5) AND date_diff('day', date_trunc('week', first), date_trunc('week', day)) % 14 = 0
  WHEN 2 THEN (wd = 2 AND (dom - 1) // 7 = 1) OR (wd = 5 AND (len - dom) // 7 = 0) WHEN 3 THEN dom IN (1, 15) OR dom = len WHEN 4 THEN month(day) IN (6, 12) AND dom = 24
  WHEN 5 THEN wd = 6 AND day <= DATE '2026-08-15' ELSE wd <= 5 AND dom >= len - 2 AND dom = len - greatest(0, isodow(last_day(day)) - 5) END AS hit FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY day) AS i FROM h WHERE hit)
SELECT rule_id, day::VARCHAR AS day FROM n WHERE day >= DATE '2026-04-01' AND (f <> 3 OR i <= 9)""")
def rrule_expand(spark, sf):
    """Rules of iCalendar: lists of days with and without numbers, days of the month from either end, months, counts, ends, positions."""
    k = F.col("p_partkey")
    rules = A.dealt(spark, sf, "part", "p_partkey").select(k.alias("rule_id"), F.element_at(F.array(*map(F.lit, _FORMS)), (k % 7 + 1).cast("int")).alias("rule"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 200).cast("int")).alias("first"), F.lit("2026-04-01").cast("date").alias("low"), F.lit("2027-03-31").cast("date").alias("high"))
    return recurrence.rrule_dates(rules, "rule_id", "rule", "first", "low", "high").select("rule_id", s("day"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS f, event_type AS title FROM events), g AS (SELECT *, CASE f WHEN 0 THEN 'Jeden Mittwoch im Park' WHEN 1 THEN 'Findet 14-tägig statt' WHEN 2 THEN 'Einmalig, am Montag' END AS d FROM e), k AS (SELECT *, CASE WHEN f < 2 THEN md5('textrec2|' || title || '|' || d) END AS key FROM g)
SELECT event_id, CASE WHEN f = 0 AND title <> 'view' THEN 'weekly' END AS freq, key IS NOT NULL AND title = 'view' AS asked FROM k""")
def text_recurrence_gate(spark, sf):
    """Descriptions that speak of a recurrence get the rule that was read out of them before; what was not is asked for."""
    f = F.col("event_id") % 4
    said = F.when(f == 0, "Jeden Mittwoch im Park").when(f == 1, "Findet 14-tägig statt").when(f == 2, "Einmalig, am Montag")
    rule = F.struct(F.lit("weekly").alias("freq"))
    c = A.table(spark, sf, "events").select("event_id", F.col("event_type").alias("title"), said.alias("description"), "ts", F.lit(None).cast("string").alias("rrule_raw"), F.when(F.lit(False), rule).alias("recurrence")).withColumnRenamed("ts", "starts_at")
    known = c.where("title <> 'view' and description is not null").select(F.md5(F.concat(F.lit("textrec2|"), "title", F.lit("|"), "description")).alias("content_key"), F.when(F.col("description").startswith("Jeden"), rule).alias("recurrence")).dropDuplicates(["content_key"])
    out, asked = canon.text_rules(c, known)
    key = F.md5(F.concat(F.lit("textrec2|"), "title", F.lit("|"), "description"))
    marked = out.withColumn("content_key", key).join(asked.select("content_key", F.lit(True).alias("asked")), "content_key", "left")
    return marked.select("event_id", F.col("recurrence.freq").alias("freq"), F.coalesce("asked", F.lit(False)).alias("asked"))


# ---- enrichment


@query("""WITH e AS (SELECT p_partkey AS event_id, p_partkey % 2 = 0 AS known, CASE WHEN p_partkey % 3 = 0 THEN 'stated' ELSE 'estimated' END AS basis, p_partkey % 6 = 0 AS shown, p_size - 3 AS lo, p_size + 9 AS hi FROM part)
SELECT event_id, CASE WHEN NOT known THEN NULL WHEN basis = 'stated' AND shown THEN 'stated' ELSE 'estimated' END AS price_basis, CASE WHEN NOT known THEN NULL WHEN basis = 'stated' AND shown THEN 0.8::DOUBLE WHEN basis = 'stated' THEN 0.2 ELSE 0.35 END AS price_conf,
  CASE WHEN known AND lo >= 0 THEN lo END AS age_lo, CASE WHEN known AND lo >= 0 THEN 0.8::DOUBLE END AS age_conf, NOT known AS asked FROM e""")
def enrichment_apply(spark, sf):
    """Cached estimates under their caps, by the key of an event's content; impossible ages go, and prices said to be stated without their words become estimates."""
    k, p = F.col("p_partkey"), A.table(spark, sf, "part")
    e = p.select(k.alias("event_id"), F.concat("p_name", k).alias("title"), F.concat(F.lit("About "), "p_name", F.when(k % 6 == 0, ": Eintritt 5 Euro").otherwise("")).alias("description"), F.lit("music").alias("category"), F.lit("Hall").alias("venue_name"), F.lit(None).cast("double").alias("price_min"), F.lit(None).cast("double").alias("price_max"))
    none = F.lit(None).cast("string")
    key = F.md5(F.concat_ws("\n", F.lit("v6"), "title", "description", "category", "venue_name", none, none))
    cache = e.where("event_id % 2 = 0").select(key.alias("content_key"), F.when(F.col("event_id") % 3 == 0, "stated").otherwise("estimated").alias("price_basis"), F.lit("eintritt 5 EURO").alias("price_evidence"), F.lit(0.95).alias("price_conf"), F.lit(0.95).alias("age_conf"), "event_id", F.lit(True).alias("cached"))
    ages = p.select(k.alias("event_id"), (F.col("p_size") - 3).alias("age_lo"), (F.col("p_size") + 9).alias("age_hi_excl"))
    out, asked = canon.apply_enrichment(e, cache.join(ages, "event_id").drop("event_id"))
    return out.join(asked.select("event_id", F.lit(True).alias("asked")), "event_id", "left").select("event_id", "price_basis", "price_conf", "age_lo", "age_conf", F.coalesce("asked", F.lit(False)).alias("asked"))


# ---- gates on titles, places and people

_PLAIN = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' Events 2026' WHEN 1 THEN 'Programm: ' || p_name WHEN 2 THEN p_name ELSE 'Kalender & Termine' END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) || ' Haus' END AS source FROM part),
w AS (SELECT p_partkey, list_filter({_PLAIN.format("title")}, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains(['event', 'events', 'veranstaltung', 'veranstaltungen', 'termin', 'termine', 'programm', 'kalender', 'highlights', 'und', 'and'], x)) AS own, {_PLAIN.format("source")} AS theirs FROM t)
SELECT w.p_partkey, len(list_filter(own, lambda x: NOT list_contains(theirs, x))) = 0 AS placeholder, w.p_partkey % 5 IN (0, 2) AS notice,
  w.p_partkey % 5 IN (0, 1, 2) AS generic, w.p_partkey % 3 = 1 AND w.p_partkey % 2 = 0 AS private FROM w""")
def title_gates(spark, sf):
    """Placeholders of a source's own name, notices, generic places, private addresses."""
    k, p = F.col("p_partkey"), A.table(spark, sf, "part")
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit(" Events 2026"))).when(k % 4 == 1, F.concat(F.lit("Programm: "), "p_name")).when(k % 4 == 2, F.col("p_name")).otherwise("Kalender & Termine")
    source = F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat(F.substring_index("p_name", " ", 1), F.lit(" Haus")))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    notice = F.concat("p_name", pick(" bis Mai geschlossen", " Wiedereröffnungsfeier", ": Wiedereröffnung am Montag", "", " Konzert"))
    where = pick("Linz", " LINZ  Innenstadt ", "Hauptstraße 12", "Posthof", "Halle 7")
    private = text.is_private(pick("Hauptstraße 12", "Stadtpark").cast("string"), pick("Verein Linz", "Anna Maier", "Anna Maria von Maier Huber"))
    return p.select("p_partkey", text.is_placeholder(title, source).alias("placeholder"), text.is_non_event(notice).alias("notice"), text.is_generic_location(where).alias("generic"), private.alias("private"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN p_name || ' & Tea' WHEN 4 THEN 'Hof' WHEN 5 THEN p_name || ' – Linz' ELSE p_name END AS title FROM part""")
def clean_titles(spark, sf):
    """Titles without ornaments, selling words, escaped signs and the venue's name, of which four characters must be left."""
    k, p = F.col("p_partkey"), A.table(spark, sf, "part")
    tails = F.array(F.lit(" 🎷❤ - fast ausverkauft"), F.lit("  - Posthof Linz"), F.lit(" | Tickets jetzt sichern"), F.lit(" &amp;amp; Tea"), F.lit(""), F.lit(" – Linz, Posthof"))
    title = F.when(k % 6 == 4, F.lit("Hof")).otherwise(F.concat(F.col("p_name"), F.element_at(tails, (k % 6 + 1).cast("int"))))
    venue = F.when(k % 6 == 4, F.lit("Hof")).otherwise(F.lit("Posthof"))
    rows = p.select("p_partkey", text.clean_text(title).alias("t"), venue.alias("v"))
    return rows.select("p_partkey", text.clean_title(F.col("t"), F.col("v")).alias("title"))


# ---- grouping, stage by stage

_TWIN = """c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS claim_id, 't' || l_partkey AS norm, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'cell' ELSE 'p' || CASE WHEN l_partkey % 3 = 0 THEN l_linenumber % 2 ELSE 0 END END AS place, l_linenumber % 4 >= 2 AS placed,
  DATE '2026-01-01' + (l_orderkey % 400)::INT AS day, CASE WHEN l_partkey % 5 = 0 AND l_linenumber IN (3, 4, 6) THEN CASE WHEN l_linenumber = 4 AND l_partkey % 10 = 5 THEN 'TU' ELSE 'MO' END END AS rule FROM lineitem),
k AS (SELECT *, 'series|' || norm || '|' || place AS series_key, norm || '|' || day || '|' || place AS fingerprint FROM c), s AS (SELECT series_key FROM k GROUP BY ALL HAVING count(DISTINCT day) >= 3 OR bool_or(rule IS NOT NULL)),
w AS (SELECT k.*, s.series_key IS NOT NULL AS whole FROM k LEFT JOIN s USING (series_key)), g AS (SELECT *, CASE WHEN whole THEN series_key ELSE fingerprint END AS grp FROM w),
u AS (SELECT grp, norm, bool_or(placed) AS placed, bool_or(whole) AS whole, min(CASE WHEN rule IS NOT NULL THEN struct_pack(c := claim_id, r := rule) END).r AS rule FROM g GROUP BY ALL),
one AS (SELECT norm, min(grp) AS twin, min(rule) AS twin_rule FROM u WHERE placed AND whole GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT u.grp, twin FROM u JOIN one USING (norm) WHERE NOT placed AND (rule = twin_rule OR EXISTS (SELECT 1 FROM g a JOIN g b USING (day) WHERE a.grp = u.grp AND b.grp = one.twin)))"""


@query(f"""WITH {_TWIN} SELECT claim_id, coalesce(twin, grp) AS group0 FROM g LEFT JOIN t USING (grp)""")
def canon_twins(spark, sf):
    """Whole groups without a venue join the only series with one under their title, if they share a date or have its rule."""
    c = _twin_claims(spark, sf)
    return canon.absorb_twins(c).select("claim_id", "group0")


_RULE = "struct<freq: string, weekday: string, week_of_month: int, interval: int, valid_from: date, valid_until: date, except_holidays: array<string>, minutes: int, duration_minutes: int>"


def _rule(weekday, freq="weekly"):
    none = F.lit(None)
    fields = {"freq": F.lit(freq), "weekday": weekday, "week_of_month": none, "interval": F.lit(1), "valid_from": none, "valid_until": none, "except_holidays": F.array(), "minutes": F.lit(600), "duration_minutes": none}
    return F.when(weekday.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items()))).cast(_RULE)


def _twin_claims(spark, sf):
    li, p, n = A.table(spark, sf, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    place = F.when(n % 4 == 0, "").when(n % 4 == 1, "cell").otherwise(F.concat(F.lit("p"), F.when(p % 3 == 0, n % 2).otherwise(0)))
    weekday = F.when((p % 5 == 0) & n.isin(3, 4, 6), F.when((n == 4) & (p % 10 == 5), "TU").otherwise("MO"))
    c = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("claim_id"), F.concat(F.lit("t"), p).alias("norm"), place.alias("place"), F.when(n % 4 >= 2, place).alias("venue"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("l_orderkey") % 400).cast("int")).alias("day"), _rule(weekday).alias("recurrence"))
    return c.select("*", F.concat_ws("|", F.lit("series"), "norm", "place").alias("series_key"), F.concat_ws("|", "norm", F.col("day").cast("string"), "place").alias("fingerprint"), F.lit(None).cast("string").alias("rrule_raw"))


@query(f"""WITH {_TWIN}, fit AS (SELECT claim_id, series_key, fingerprint, day, CASE WHEN rule = ['MO', 'TU', 'WE', 'TH', 'FR', 'SA', 'SU'][isodow(day)] THEN rule END AS rule FROM k),
own AS (SELECT series_key FROM fit GROUP BY 1 HAVING count(DISTINCT day) >= 3 OR bool_or(rule IS NOT NULL))
SELECT claim_id, rule AS weekday, series_key IN (SELECT series_key FROM own) AS in_series FROM fit""")
def canon_rule_fit(spark, sf):
    """Rules that can't make their claim's own weekday make no series of it."""
    c = canon.fitting_rules(_twin_claims(spark, sf))
    own = canon.series(c).select("series_key", F.lit(True).alias("in_series"))
    return c.join(own, "series_key", "left").select("claim_id", F.col("recurrence.weekday").alias("weekday"), F.coalesce("in_series", F.lit(False)).alias("in_series"))


@query("""WITH c AS (SELECT 'g' || l_orderkey AS grp, 'f' || l_partkey AS fp FROM lineitem), m AS (SELECT fp, min(grp) AS b FROM c GROUP BY 1) SELECT DISTINCT grp AS a, b FROM c JOIN m USING (fp) WHERE grp <> b""")
def canon_shared_prints(spark, sf):
    li = A.table(spark, sf, "lineitem").select(F.concat(F.lit("g"), "l_orderkey").alias("grp"), F.concat(F.lit("f"), "l_partkey").alias("fingerprint"))
    return canon.shared_prints(li, "grp")


_WORDS = "list_filter({0}, lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in dict.fromkeys(text.STOP_WORDS)) + "], x))"
_TITLES = f"""{A.TITLE_SQL}, n AS (SELECT doc_id, source, lower(strip_accents(replace(replace(replace(replace(lower(title), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'))) AS t FROM title), w AS (SELECT doc_id, source, {_WORDS.format(_PLAIN.format("t"))} AS w FROM n),
tri AS (SELECT *, array_to_string(w, ' ') AS norm, list_distinct(list_transform(range(1, length('  ' || array_to_string(w, ' ') || ' ') - 1), lambda i: substring('  ' || array_to_string(w, ' ') || ' ', i, 3))) AS g, list_distinct(w) AS dw FROM w)"""
_ALIKE = """len(list_intersect(l.g, r.g)) / len(list_distinct(list_concat(l.g, r.g)))::DOUBLE AS j, CASE WHEN least(len(l.dw), len(r.dw)) = 0 THEN 0 ELSE len(list_intersect(l.dw, r.dw)) / least(len(l.dw), len(r.dw))::DOUBLE END AS c, least(len(l.dw), len(r.dw)) AS short"""


@query(f"""WITH {_TITLES}, f AS (SELECT *, 'f' || doc_id AS fp, DATE '2026-01-01' + (doc_id % 3)::INT AS day, (DATE '2026-01-01' + (doc_id % 3)::INT)::TIMESTAMP + to_minutes((doc_id % 7 * 20 + 600)::INT) AS at, CASE WHEN doc_id % 2 = 0 THEN 'v' || doc_id % 2 END AS venue FROM tri),
x AS (SELECT DISTINCT fp, unnest(list_concat(CASE WHEN doc_id % 4 = 0 THEN [day || '|p' || doc_id % 9] ELSE [] END, list_transform(list_filter(w, lambda z: length(z) >= 4 AND NOT regexp_matches(z, '^[0-9]+$')), lambda z: day || '|w|' || z))) AS k FROM f),
b AS (SELECT * FROM x WHERE k IN (SELECT k FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)), p AS (SELECT DISTINCT l.fp AS a, r.fp AS b FROM b l JOIN b r ON l.k = r.k AND l.fp < r.fp),
z AS (SELECT a, b, {_ALIKE}, abs(date_diff('microsecond', l.at, r.at)) / 60e6 AS mins, l.venue AS va, r.venue AS vb FROM p JOIN f l ON l.fp = a JOIN f r ON r.fp = b),
q AS (SELECT a, b, round(0.35 * greatest(j, c * CASE WHEN short = 1 THEN 0.60 ELSE 0.72 END) + 0.25 * CASE WHEN mins <= 30 THEN 1.0 WHEN mins <= 180 THEN 0.4 ELSE 0 END + 0.20 * CASE WHEN va = vb THEN 1.0 WHEN va IS NOT NULL AND vb IS NOT NULL THEN 0.0 ELSE 0.5 END + 0.10 * 0.5 + 0.10 * 0.4, 6) AS score FROM z)
SELECT a, b, CASE WHEN score > 0.8 THEN 'merged' WHEN md5(a || chr(10) || b) LIKE '0%' THEN 'merged' WHEN md5(a || chr(10) || b) LIKE '1%' THEN 'apart' ELSE 'asked' END AS outcome FROM q WHERE score >= 0.5 AND outcome <> 'apart'""")
def canon_claim_links(spark, sf):
    """Claims of one event by pair scores within blocks; between the thresholds by verdicts, of which some are missing and asked for."""
    k, t = F.col("doc_id"), A.titles(spark, sf)
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 3).cast("int"))
    none = F.lit(None).cast("string")
    at = F.to_utc_timestamp(F.timestamp_add("MINUTE", (k % 7 * 20 + 600).cast("int"), day.cast("timestamp")), "Europe/Vienna")
    place = F.when(k % 4 == 0, F.concat(F.lit("p"), k % 9)).otherwise("")
    c = t.select(F.concat(F.lit("f"), k).alias("fingerprint"), F.concat(F.lit("f"), k).alias("group0"), k.alias("source_id"), k.cast("string").alias("claim_id"), "title", text.normalize_title(F.col("title")).alias("norm"), day.alias("day"), place.alias("place"), at.alias("starts_at"), F.when(k % 2 == 0, F.concat(F.lit("v"), k % 2)).alias("venue"), F.lit("").alias("cell"), none.alias("url"), none.alias("organizer"))
    return _answered(canon.claim_links, c)


def _answered(find, c):
    """Links and open questions once some of those that came up were answered: keys that begin with 0 mean the same, with 1 not."""
    none = c.sparkSession.createDataFrame([], "key string, same boolean")
    digit = F.substring("key", 1, 1)
    links, asked = find(c, find(c, none)[1].where(digit.isin("0", "1")).select("key", (digit == "0").alias("same")).distinct())
    return links.select("a", "b", F.lit("merged").alias("outcome")).unionByName(asked.select("a", "b", F.lit("asked").alias("outcome")))


@query(f"""WITH {_TITLES}, f AS (SELECT *, 'g' || doc_id AS grp, CASE WHEN doc_id % 3 <> 0 THEN ['v' || doc_id % 3] ELSE [] END AS venues, DATE '2026-01-01' + (doc_id % 90 * 2)::INT AS lo, DATE '2026-01-01' + (doc_id % 90 * 2 + [0, 120, 2, 3][doc_id % 4 + 1])::INT AS hi, doc_id % 4 + 1 AS n_days,
  list_filter(dw, lambda z: length(z) >= 4 AND NOT regexp_matches(z, '^[0-9]+$')) AS keys FROM tri), o AS (SELECT *, norm || '|' || array_to_string(venues, '|') AS profile FROM f),
x AS (SELECT grp, unnest(keys) AS k FROM o), b AS (SELECT * FROM x WHERE k IN (SELECT k FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 15)), p AS (SELECT DISTINCT l.grp AS a, r.grp AS b FROM b l JOIN b r ON l.k = r.k AND l.grp < r.grp),
z AS (SELECT a, b, {_ALIKE}, len(list_intersect(l.keys, r.keys)) / least(len(l.keys), len(r.keys))::DOUBLE AS held, len(l.venues) > 0 AND len(r.venues) > 0 AND l.venues <> r.venues AS apart, least(abs(l.lo - r.lo), abs(l.lo - r.hi), abs(l.hi - r.lo), abs(l.hi - r.hi)) AS gap, greatest(l.n_days, r.n_days) >= 3 AS long,
  l.profile = r.profile AS same, md5('groups|' || least(l.profile, r.profile) || '||' || greatest(l.profile, r.profile)) AS key FROM p JOIN o l ON l.grp = a JOIN o r ON r.grp = b)
SELECT a, b, CASE WHEN same THEN 'merged' WHEN key LIKE '0%' THEN 'merged' WHEN key LIKE '1%' THEN 'apart' ELSE 'asked' END AS outcome FROM z WHERE (held >= 0.8 OR greatest(j, c * CASE WHEN short = 1 THEN 0.60 ELSE 0.72 END) >= 0.55) AND (NOT apart OR held = 1) AND (long OR gap <= 60) AND outcome <> 'apart'""")
def canon_group_links(spark, sf):
    """Whole groups that may be one event: alike titles, places that fit, and for short runs closest dates that do (some runs straddle others); equal profiles merge, the rest by verdicts."""
    k, t = F.col("doc_id"), A.titles(spark, sf)
    first = F.date_add(F.lit("2026-01-01").cast("date"), (k % 90 * 2).cast("int"))
    days = F.when(k % 4 == 0, F.array(first)).when(k % 4 == 1, F.array(first, F.date_add(first, 120))).otherwise(F.sequence(first, F.date_add(first, (k % 4).cast("int"))))
    c = t.select(F.concat(F.lit("g"), k).alias("group1"), k.cast("string").alias("claim_id"), F.lit(0.5).alias("trust"), "title", text.normalize_title(F.col("title")).alias("norm"), F.when(k % 3 != 0, F.concat(F.lit("v"), k % 3)).alias("venue"), F.explode(days).alias("day"))
    return _answered(canon.group_links, c)


_SAID = f"""{A.CLAIM_SQL}, said AS (SELECT *, trust * confidence AS w, CASE WHEN split_part(event_id, '|', 1)::BIGINT % 5 = 0 THEN 'a meetup' ELSE source_name END AS sname, CASE WHEN quantity > 30 THEN 'https://x.at/' || source_id ELSE 'https://x.at/' END AS link,
  CASE WHEN price / 1000 < 70 THEN price / 1000 END AS pm, CASE WHEN source_id % 2 = 0 THEN 'music' WHEN source_id % 3 = 0 THEN 'fun' END AS cat, CASE WHEN split_part(event_id, '|', 1)::BIGINT % 4 <> 0 THEN 'v1' END AS venue FROM claim)"""


@query(f"""WITH {_SAID}, t AS (SELECT event_id, title FROM said QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY w DESC, length(title) DESC, claim_id DESC) = 1), u AS (SELECT event_id, link AS url FROM said QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY w * CASE WHEN quantity > 30 THEN 1.0 ELSE 0.8 END DESC, length(link) DESC, claim_id DESC) = 1),
p AS (SELECT event_id, pm AS price_min, claim_id AS price_claim FROM said WHERE pm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY w DESC, claim_id DESC) = 1), c AS (SELECT event_id, cat FROM said WHERE cat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY w DESC, claim_id DESC) = 1),
v AS (SELECT event_id, source_id, max(least(w, 0.999999)) AS v FROM said GROUP BY ALL), n AS (SELECT event_id, 1 - exp(sum(ln(1 - v))) AS confidence, count(*) AS n_sources FROM v GROUP BY 1), g AS (SELECT event_id, any_value(venue) AS venue, bool_and(sname ILIKE '%meetup%') AS only_global FROM said GROUP BY 1)
SELECT event_id, title, url, round(price_min, 6) AS price_min, price_claim, CASE WHEN cat = 'music' THEN cat END AS category, round(confidence, 6) AS confidence, n_sources FROM n JOIN t USING (event_id) JOIN u USING (event_id) JOIN g USING (event_id) LEFT JOIN p USING (event_id) LEFT JOIN c USING (event_id)
WHERE NOT (venue IS NULL AND only_global AND event_id LIKE '%9')""")
def canon_events(spark, sf):
    """Merged fields with the claim behind the price, confidence, known categories only; padding of global platforms without a place goes, unless its page is Austrian."""
    c, k = A.claims(spark, sf, deal="part"), F.col("part_no")
    none = lambda kind: F.lit(None).cast(kind)
    host = F.when(F.col("event_id").endswith("9") & (k % 4 == 0) & (k % 5 == 0), "com").otherwise("at")
    url = F.when(F.col("quantity") > 30, F.concat(F.lit("https://x."), host, F.lit("/"), "source_id")).otherwise(F.concat(F.lit("https://x."), host, F.lit("/")))
    rows = c.select(
        "part_no", "event_id", "claim_id", "source_id", F.when(k % 5 == 0, "a meetup").otherwise(F.col("source_name")).alias("source_name"), "trust", "confidence", "extracted_at", "title", none("string").alias("description"), none("string").alias("venue_name"), none("string").alias("address"), url.alias("url"),
        F.when(F.col("price") / 1000 < 70, F.col("price") / 1000).alias("price_min"), none("double").alias("price_max"), F.when(F.col("source_id") % 2 == 0, "music").when(F.col("source_id") % 3 == 0, "fun").alias("category"), none("string").alias("organizer"), none("double").alias("lat"), none("double").alias("lon"), F.when(k % 4 != 0, "v1").alias("venue"),
    )
    e = canon.events(rows, lie_by="part_no")
    return e.select("event_id", "title", F.replace("url", F.lit("x.com"), F.lit("x.at")).alias("url"), r6("price_min").alias("price_min"), F.col("field_provenance")["price_min"]["claim_id"].alias("price_claim"), "category", r6("confidence").alias("confidence"), "n_sources")


# ---- the rebuild

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(text.STOP_WORDS))
#: Claims as _canon() makes them, cleaned and with their keys. All dates are within the retention window.
_LOADED = f"""{A.CLAIM_SQL}, raw AS (SELECT *, 'Fest ' || title AS t, 'Saal ' || source_id % 40 AS venue FROM claim),
norm AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains([{_STOP}], w)), ' ') AS norm, {VIENNA.format("starts_at")}::DATE AS day FROM raw),
newest AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY source_id, norm, day, lower(venue) ORDER BY extracted_at DESC, claim_id) = 1),
loaded AS (SELECT *, norm || '|' || day || '|name:' || lower(venue) AS fingerprint, 'series|' || norm || '|name:' || lower(venue) AS series_key FROM newest WHERE day BETWEEN DATE '1996-06-01' - 90 AND DATE '1996-06-01' + 550)"""


@query(f"WITH {_LOADED} SELECT claim_id, fingerprint, round(CASE WHEN price / 1000 BETWEEN 0 AND 500 THEN price / 1000 END, 6) AS price_min FROM loaded")
def canon_load(spark, sf):
    """Newest claims within the window, cleaned, each under its fingerprint."""
    claims, venues_ = _claims(spark, sf)
    # read twice, as in rebuild()
    found = canon.fingerprints(canon.place(written(canon.load(claims, _now()), "claims-loaded"), venues_))
    return found.select("claim_id", "fingerprint", r6("price_min").alias("price_min"))


@query(f"WITH {_LOADED}, g AS (SELECT series_key FROM loaded GROUP BY 1 HAVING count(DISTINCT day) >= 3) SELECT claim_id, CASE WHEN series_key IN (SELECT series_key FROM g) THEN series_key ELSE fingerprint END AS group0 FROM loaded")
def canon_series(spark, sf):
    """Claims by their series (three dates under one title and place), or their own fingerprint."""
    claims, venues_ = _claims(spark, sf)
    c = written(canon.fingerprints(canon.place(written(canon.load(claims, _now()), "claims-loaded"), venues_)), "claims-placed")
    return canon.absorb_twins(c).select("claim_id", "group0")


#: Two versions of the canon. Before: prints of parts 3 to a event (splits), third lines 9 to an event (merges), series whose old dates have gone, prints that no claim has any more.
_BEFORE = """p AS (SELECT 'g' || l_partkey AS grp, 'f' || l_partkey || '-' || l_linenumber AS fp, l_shipdate AS seen FROM lineitem UNION ALL SELECT 'g' || l_partkey, 'series|' || l_partkey, l_shipdate FROM lineitem WHERE l_partkey % 4 = 0),
i AS (SELECT 'f' || l_partkey || '-' || l_linenumber AS fp, 'e' || l_partkey // 6 AS ev, min(l_shipdate) - INTERVAL 10 DAY AS was FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 3 = 0 GROUP BY 1, 2
  UNION ALL SELECT 'f' || l_partkey || '-3', 'm' || l_partkey // 9, min(l_shipdate) FROM lineitem WHERE l_linenumber = 3 AND l_partkey % 3 = 0 GROUP BY 1, 2
  UNION ALL SELECT 'old' || p_partkey, 'e' || p_partkey // 6, TIMESTAMP '1991-01-01' + to_days((p_partkey % 300)::INT) FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT 'series|' || p_partkey, 's' || p_partkey, TIMESTAMP '1990-01-01' FROM part WHERE p_partkey % 4 = 0)"""
_AFTER = f"""{_BEFORE}, q AS (SELECT grp, fp, min(seen) AS seen FROM p GROUP BY 1, 2), w AS (SELECT grp, min(fp) AS least, min(seen) AS seen FROM q GROUP BY 1), age AS (SELECT ev, min(was) AS age FROM i GROUP BY 1),
own AS (SELECT DISTINCT grp, ev, age, least FROM q JOIN i USING (fp) JOIN age USING (ev) JOIN w USING (grp)), turn AS (SELECT grp, least, arg_min(ev, (age, ev)) AS oldest, row_number() OVER (ORDER BY min((age, ev)), least) AS turn FROM own GROUP BY 1, 2),
took AS (SELECT ev, arg_min(grp, turn) AS first FROM own JOIN turn USING (grp) GROUP BY 1), kept AS (SELECT grp, bool_and(first = grp) AS kept FROM own JOIN took USING (ev) GROUP BY 1),
ids AS (SELECT w.grp, w.seen, CASE WHEN kept THEN oldest WHEN oldest IS NULL THEN md5('event' || chr(10) || w.least) ELSE md5('split' || chr(10) || oldest || chr(10) || w.least) END AS id FROM w LEFT JOIN turn USING (grp) LEFT JOIN kept USING (grp)),
after AS (SELECT coalesce(i.fp, q.fp) AS fp, coalesce(ids.id, moved.id, i.ev) AS ev, coalesce(i.was, ids.seen) AS was FROM i FULL JOIN q USING (fp) LEFT JOIN ids ON q.grp = ids.grp LEFT JOIN took ON took.ev = i.ev LEFT JOIN ids moved ON moved.grp = took.first)"""


def _versions(spark, sf):
    li, p = A.table(spark, sf, "lineitem"), A.table(spark, sf, "part")
    k, n, part = F.col("l_partkey"), F.col("l_linenumber"), F.col("p_partkey")
    fp, series_ = F.concat(F.lit("f"), k, F.lit("-"), n), F.concat(F.lit("series|"), k)
    group = F.concat(F.lit("g"), k).alias("group")
    groups = li.select(group, fp.alias("fingerprint"), F.col("l_shipdate").alias("extracted_at")).unionByName(li.where(k % 4 == 0).select(group, series_.alias("fingerprint"), F.col("l_shipdate").alias("extracted_at")))
    first = F.min("l_shipdate")
    of = lambda rows, ev, seen: rows.groupBy(fp.alias("fingerprint"), ev.alias("event_id")).agg(seen.alias("first_seen"))
    known = of(li.where((n <= 2) & (k % 3 == 0)), F.concat(F.lit("e"), F.floor(k / 6)), first - F.expr("INTERVAL 10 DAYS")).unionByName(of(li.where((n == 3) & (k % 3 == 0)), F.concat(F.lit("m"), F.floor(k / 9)), first))
    gone = p.where(part % 5 == 0).select(F.concat(F.lit("old"), part).alias("fingerprint"), F.concat(F.lit("e"), F.floor(part / 6)).alias("event_id"), F.timestamp_add("DAY", (part % 300).cast("int"), F.lit("1991-01-01").cast("timestamp_ntz")).alias("first_seen"))
    old = p.where(part % 4 == 0).select(F.concat(F.lit("series|"), part).alias("fingerprint"), F.concat(F.lit("s"), part).alias("event_id"), F.lit("1990-01-01").cast("timestamp_ntz").alias("first_seen"))
    return groups, written(known.unionByName(gone).unionByName(old), "identity-before")


@query(f"WITH {_AFTER} SELECT fp AS fingerprint, ev AS event_id, was::VARCHAR AS first_seen FROM after")
def canon_identity(spark, sf):
    """The identity table of the next version: merges, splits, series known by their key alone, and old prints that follow their event."""
    return canon.identify(*_versions(spark, sf)).select("fingerprint", "event_id", s("first_seen"))


@query(f"""WITH {_AFTER}, moves AS (SELECT DISTINCT i.ev, after.ev AS now FROM i JOIN after USING (fp)), fates AS (SELECT ev, list(now ORDER BY now) AS now FROM moves GROUP BY 1)
SELECT ev AS event_id, CASE WHEN len(now) > 1 THEN 'split' WHEN now[1] = ev THEN 'kept' ELSE 'merged' END AS fate, array_to_string(now, ',') AS into FROM fates
UNION ALL SELECT DISTINCT ev, 'new', ev FROM after WHERE ev NOT IN (SELECT ev FROM i) AND ev NOT IN (SELECT now FROM moves)""")
def canon_lineage(spark, sf):
    """What became of each event between the two versions."""
    groups, before = _versions(spark, sf)
    found = canon.lineage(before, written(canon.identify(groups, before), "identity"))
    return found.select("event_id", "fate", F.array_join("into", ",").alias("into"))


_SCHEDULE = f"""c AS (SELECT 'v' || l_partkey AS event_id, ((l_shipdate + to_minutes(CASE WHEN q % 4 = 0 THEN 0 ELSE 1200 END)) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' AS st, q % 4 <> 0 AS timed, CASE q % 5 WHEN 1 THEN 2 WHEN 2 THEN 13 WHEN 3 THEN 72 WHEN 4 THEN 720 END AS hours, l_partkey % 6 = 0 AS art, l_partkey % 2 = 0 AS series FROM (SELECT *, l_quantity::INT AS q FROM lineitem)),
e AS (SELECT *, st + to_hours(hours::INT) AS en, hours IS NOT NULL AND (hours <= 240 OR (art AND hours <= 8880)) AS sane FROM c), m AS (SELECT event_id, min(st) AS low, max(st) AS high FROM e WHERE NOT timed AND hours IS NOT NULL AND NOT sane GROUP BY 1)"""


@query(f"""WITH {_SCHEDULE} SELECT event_id, st::VARCHAR AS starts_at, CASE WHEN sane AND NOT (series AND timed AND hours > 12 AND EXISTS (SELECT 1 FROM e x WHERE x.event_id = e.event_id AND x.st > e.st AND x.st < e.en)) THEN en END::VARCHAR AS ends_at, timed
FROM e LEFT JOIN m USING (event_id) WHERE NOT (NOT timed AND hours IS NOT NULL AND NOT sane AND low < high)""")
def schedule_ends(spark, sf):
    """Observed dates without the first days of ranges that contradict each other, and without ends that pass a sibling's start."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_partkey")
    at = recurrence.local_start(F.col("l_shipdate").cast("date"), F.when(q % 4 == 0, 0).otherwise(1200))
    hours = F.when(q % 5 == 1, 2).when(q % 5 == 2, 13).when(q % 5 == 3, 72).when(q % 5 == 4, 720)
    rows = A.table(spark, sf, "lineitem").select(F.concat(F.lit("v"), k).alias("event_id"), at.alias("starts_at"), F.timestamp_add("HOUR", hours, at).alias("ends_at"), F.when(k % 6 == 0, "art").otherwise("music").alias("category"), F.when(k % 2 == 0, "series|x").otherwise("x").alias("group0"))
    return canon.observed_dates(rows).select("event_id", s("starts_at"), s("ends_at"), "timed")


@query(f"""WITH {A.CLAIM_SQL}, d AS (SELECT event_id, claim_id, starts_at::DATE AS day FROM claim), f AS (SELECT event_id, min(day) AS first, arg_min(claim_id, (day, claim_id)) AS claim FROM d GROUP BY 1), r AS (SELECT *, isodow(first) AS wd FROM f WHERE split_part(event_id, '|', 1)::BIGINT % 2 = 0),
x AS (SELECT event_id, unnest(generate_series(greatest(first, DATE '1996-05-31'), DATE '1996-07-27', INTERVAL 1 DAY))::DATE AS day, wd FROM r WHERE first <= DATE '1996-07-27')
SELECT event_id, (((day::TIMESTAMP + INTERVAL 20 HOUR) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC')::VARCHAR AS starts_at FROM x WHERE isodow(day) = wd AND ((day::TIMESTAMP + INTERVAL 20 HOUR) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC' BETWEEN TIMESTAMP '1996-05-31 12:00:00' AND TIMESTAMP '1996-07-27 00:00:00'""")
def canon_raw_rules(spark, sf):
    """Dates of the events whose claims bring a calendar's own rule: at the first claim's time, from half a day ago to the horizon."""
    from pyspark.sql.types import StringType

    c = A.claims(spark, sf)
    local = recurrence.local_start(F.col("starts_at").cast("date"), F.lit(1200))
    even = F.split("event_id", r"\|")[0].cast("bigint") % 2 == 0
    rows = c.select("event_id", "claim_id", "extracted_at", local.alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), F.lit("music").alias("category"), F.col("starts_at").cast("date").alias("day"), F.when(even, "FREQ=WEEKLY").cast(StringType()).alias("rrule_raw"))
    return canon.raw_occurrences(rows.where(even), F.lit("1996-06-01 00:00:00").cast("timestamp")).select("event_id", s("starts_at"))


@query(f"""WITH {A.CLAIM_SQL} SELECT event_id, greatest(max(starts_at::DATE), max({VIENNA.format("extracted_at")}::DATE + CASE WHEN source_id % 3 <> 0 THEN (source_id % 200)::INT END))::VARCHAR AS edge FROM claim GROUP BY 1""")
def coverage_edge(spark, sf):
    k = F.col("source_id")
    c = A.claims(spark, sf).select("event_id", F.col("starts_at").cast("date").alias("day"), F.col("extracted_at").cast("timestamp").alias("extracted_at"), F.when(k % 3 != 0, (k % 200) + 0.9).alias("horizon_days"))
    return canon.coverage_edge(c).select("event_id", s("edge"))


@query(f"""WITH {A.CALENDAR_SQL}, judged AS (SELECT * FROM found WHERE series_id % 5 <> 0), seen AS (SELECT DISTINCT series_id, day FROM calendar WHERE series_id % 7 <> 3),
ahead AS (SELECT j.series_id, last_day + (i * cadence)::INT AS day FROM judged j, range(1, 5) t(i) WHERE cadence IS NOT NULL AND i * cadence <= 28 AND series_id % 7 <> 3 AND last_day + (i * cadence)::INT > CASE WHEN series_id % 2 = 0 THEN greatest(last_day, DATE '2026-03-01' + 20) ELSE last_day END),
o AS (SELECT series_id, day, false AS projected FROM seen UNION ALL SELECT series_id, day, true FROM ahead)
SELECT 'e' || series_id AS event_id, (((day::TIMESTAMP + INTERVAL 19 HOUR) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC')::VARCHAR AS starts_at, (((day::TIMESTAMP + INTERVAL 21 HOUR) AT TIME ZONE 'Europe/Vienna') AT TIME ZONE 'UTC')::VARCHAR AS ends_at, projected, false AS time_unknown FROM o""")
def canon_series_occurrences(spark, sf):
    """Observed dates of series, and those that their cadence promises beyond what the sources see, where the series was judged to recur; none of what is no event."""
    k = F.col("series_id")
    none = F.lit(None)
    at = recurrence.local_start(F.col("day"), F.lit(19 * 60))
    rule = none.cast("struct<freq: string, weekday: string, week_of_month: int, interval: int, valid_from: date, valid_until: date, except_holidays: array<string>, minutes: int, duration_minutes: int>")
    c = A.calendar(spark, sf).select(
        F.concat(F.lit("e"), k).alias("event_id"), "day", at.alias("starts_at"), F.timestamp_add("MINUTE", F.lit(120), at).alias("ends_at"), F.concat(F.lit("series|"), k).alias("group0"), F.concat_ws("-", k, F.col("day").cast("string")).alias("claim_id"),
        F.lit("2026-03-01").cast("timestamp").alias("extracted_at"), F.when(k % 2 == 0, 20.0).alias("horizon_days"), F.lit("music").alias("category"), none.cast("string").alias("rrule_raw"), rule.alias("recurrence"),
    )
    verdict = F.when(k % 7 == 3, "not_an_event").when(k % 5 != 0, "recurring").otherwise("one_off")
    judged = A.calendar(spark, sf).select(F.concat(F.lit("e"), k).alias("event_id"), verdict.alias("verdict")).distinct()
    found = canon.occurrences(c, A.holidays(spark), spark.createDataFrame([], "event_id string, verified boolean"), judged, F.lit("2026-03-01").cast("timestamp"))
    return found.select("event_id", s("starts_at"), s("ends_at"), "projected", "time_unknown")


@query()
def canon_rebuild(spark, sf):
    """All claims through the whole rebuild: one row for each canonical event. Its stages have their SQL above."""
    found = _canon(spark, sf)
    return found.events.select("event_id", "title", r6("confidence").alias("confidence"), "n_sources", "category", "price_min")


@query()
def canon_occurrences(spark, sf):
    return _canon(spark, sf).occurrences.select("event_id", "occurrence_id", s("starts_at"), s("ends_at"), "projected", "time_unknown")


def _now():
    return F.lit("1996-06-01").cast("timestamp")


def _claims(spark, sf):
    none = lambda kind: F.lit(None).cast(kind)
    c = A.claims(spark, sf)
    claims = c.select(
        "claim_id", "source_id", "source_name", "trust", "extracted_at", F.concat(F.lit("Fest "), "title").alias("title"), F.col("starts_at").cast("timestamp").alias("starts_at"), none("timestamp").alias("ends_at"),
        F.concat(F.lit("Saal "), F.col("source_id") % 40).alias("venue_name"), none("string").alias("address"), none("double").alias("lat"), none("double").alias("lon"), none("string").alias("organizer"), F.concat(F.lit("https://s.at/"), "event_id").alias("url"),
        none("string").alias("description"), F.lit("music").alias("category"), (F.col("price") / 1000).alias("price_min"), none("double").alias("price_max"), "status", "confidence",
        none(_RULE).alias("recurrence"),
    )
    no_venues = spark.createDataFrame([], "venue_id long, name string, aliases array<string>, lat double, lon double")
    optional = {n: none(kind).alias(n) for n, kind in canon.OPTIONAL.items()}
    return claims.select("*", *optional.values()), no_venues


def _canon(spark, sf):
    claims, no_venues = _claims(spark, sf)
    empty = lambda schema: spark.createDataFrame([], schema)
    return canon.rebuild(claims, no_venues, A.holidays(spark), empty("fingerprint string, event_id string, first_seen timestamp_ntz"), empty("key string, same boolean"), empty("event_id string, verified boolean"), empty("event_id string, verdict string"), _now())
