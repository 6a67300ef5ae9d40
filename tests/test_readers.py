"""Readers of landed documents, on shapes that sources ship."""

import datetime as dt
import json
import random

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from evidenceloom.operators import recurrence
from evidenceloom.sources import cascade, landing, recipes
from evidenceloom.sources.scratch import written


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b, "https://x.at/list") for i, b in enumerate(bodies)], "doc_id long, body string, url string")


def read(reader, spark, *bodies, **more):
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("doc_id", "method", "confidence")} for r in reader(docs(spark, *bodies), **more).collect()]


# ---- JSON

HARBOUR = {
    "Berths": [{"Name": "North quay", "Metres": 120}, {"Name": "South quay", "Metres": 80}],
    "Sailings": [
        {"EventName": "Night sail round the light", "DateFrom": "2031-09-03T20:15:00", "DateTo": "2031-09-03T23:45:00", "Room": "Pier 9", "Teaser": "<div>Warm coat &lt;needed&gt; <i>after dark</i></div>", "Body": "unused", "Host": "Harbour Office", "PriceFrom": 31, "MinPrice": 9, "SignupUrl": "https://tickets.example/9", "Latitude": -12.5, "Longitude": 130.875},
        {"Summary": "Open lock day", "DtStart": "4 Sep 2031", "From": "2031-01-01", "Crew": [{"Name": "Ana"}, {"Name": "Bo"}]},
    ],
}


def test_json_of_a_harbour(spark):
    """Names in any case, the first name with a value, tags out of texts, lists beside the events that are none."""
    first, second = read(landing.json_api, spark, json.dumps(HARBOUR))
    assert first == {"title": "Night sail round the light", "starts_at": "2031-09-03T20:15:00", "ends_at": "2031-09-03T23:45:00", "venue_name": "Pier 9", "description": "Warm coat <needed> after dark", "organizer": "Harbour Office", "price_min": 31.0, "booking_url": "https://tickets.example/9", "lat": -12.5, "lon": 130.875}
    assert second == {"title": "Open lock day", "starts_at": "2031-01-01"}


def dated(n, of):
    """A list of so many records of which so many have a day."""
    return [{"summary": f"entry {i}", **({"begin": f"2032-02-{i + 1:02}"} if i < n else {})} for i in range(of)]


@pytest.mark.parametrize(
    ("body", "titles"),
    [
        ({"deep": {"er": {"est": dated(3, 3)}}}, ["entry 0", "entry 1", "entry 2"]),
        ({"x": dated(3, 5)}, ["entry 0", "entry 1", "entry 2"]),
        ({"x": dated(2, 4)}, []),
        ({"x": [r | {"parts": dated(2, 2)} for r in dated(1, 1)]}, ["entry 0"]),
        ({"x": [{"summary": "a number", "begin": 20320201}, {"summary": "digits", "begin": "9876543210"}]}, []),
        ({"x": [*dated(2, 2), "a word"]}, []),
        ({"x": [dated(2, 2)]}, []),
        ({"x": [{"title": ["no text"], "summary": "said so", "start": True, "to": "2032-03-01", "from": "2032-02-29"}]}, ["said so"]),
    ],
)
def test_json_lists(spark, body, titles):
    assert [r["title"] for r in read(landing.json_api, spark, json.dumps(body))] == titles


def test_json_that_is_none(spark):
    assert read(landing.json_api, spark, "<html>5.8.</html>", "{broken", "", None, "[" * 5000) == []


# ---- JSON-LD


def ld(x):
    return f'<html><script type="application/ld+json">{json.dumps(x)}</script><script>var a = {{}}</script></html>'


def test_jsonld(spark):
    gig = {
        "@type": ["Thing", "MusicEvent"], "name": "Gig", "startDate": "2026-07-05T19:00", "url": "/gig", "image": ["/a.jpg"], "organizer": [{"name": "Club"}], "offers": [{"lowPrice": "12", "highPrice": 20, "url": " https://t.at "}],
        "location": {"name": "Hall", "address": {"streetAddress": "Weg 1", "postalCode": "4020", "addressLocality": "Linz"}, "geo": {"latitude": "48.3", "longitude": 14.2}}, "subEvent": {"@type": "CourseInstance", "name": "Inner", "startDate": "2026-07-06"},
    }
    others = [{"@type": "SaleEvent", "name": "Sale", "startDate": "2026-07-05"}, {"@type": "https://schema.org/Event", "name": "Long", "startDate": "2026-07-05"}, {"@type": "Event", "name": "No date"}, {"@type": "Event", "startDate": "2026-07-05"}, {"@type": "Event", "name": "Plain", "startDate": "2026-07-05", "location": "Park", "offers": {"price": "free"}}]
    first, inner, plain = read(landing.jsonld, spark, ld({"@graph": [gig, *others]}), '<script type="application/ld+json">{broken</script>', "<p>none</p>")
    assert first == {"title": "Gig", "starts_at": "2026-07-05T19:00", "url": "https://x.at/gig", "image_url": "https://x.at/a.jpg", "organizer": "Club", "venue_name": "Hall", "address": "Weg 1 4020 Linz", "lat": 48.3, "lon": 14.2, "price_min": 12.0, "price_max": 20.0, "booking_url": "https://t.at"}
    assert inner["title"] == "Inner" and plain == {"title": "Plain", "starts_at": "2026-07-05", "venue_name": "Park"}


# ---- calendars

ICS = """BEGIN:VCALENDAR\r
BEGIN:VEVENT\r
SUMMARY:Long\r
  title\\, yes\r
DTSTART;TZID=Europe/London:20260705T190000\r
DTEND;TZID=No/Where:20260705T200000\r
RRULE:FREQ=WEEKLY;BYDAY=MO\r
LOCATION:Park\\; Linz\r
BEGIN:VALARM\r
DESCRIPTION:an alarm\r
END:VALARM\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY:No date\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY;LANGUAGE=de:Days\r
DTSTART;VALUE=DATE:20260706\r
DTEND:20260707T100000Z\r
URL:https://x.at/d\r
END:VEVENT\r
END:VCALENDAR"""


def test_calendar(spark):
    first, days = read(landing.ics, spark, ICS)
    assert first == {"title": "Long title, yes", "starts_at": "2026-07-05T19:00:00+01:00", "ends_at": "2026-07-05T20:00:00", "rrule_raw": "FREQ=WEEKLY;BYDAY=MO", "venue_name": "Park; Linz"}
    assert days == {"title": "Days", "starts_at": "2026-07-06", "ends_at": "2026-07-07T10:00:00+00:00", "url": "https://x.at/d"}


RULES = [
    "FREQ=DAILY;INTERVAL=3", "FREQ=WEEKLY", "FREQ=WEEKLY;BYDAY=MO,WE,FR;INTERVAL=2", "FREQ=WEEKLY;BYDAY=TU;COUNT=5", "FREQ=MONTHLY", "FREQ=MONTHLY;BYDAY=2TU,-1FR", "FREQ=MONTHLY;BYMONTHDAY=1,15,-1",
    "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=YEARLY", "FREQ=YEARLY;BYMONTH=6,12;BYMONTHDAY=24", "FREQ=YEARLY;BYDAY=20MO", "FREQ=YEARLY;BYMONTH=5;BYDAY=2SU", "RRULE:FREQ=WEEKLY;UNTIL=20260815;BYDAY=SA",
    "FREQ=DAILY;COUNT=10;BYDAY=SA,SU", "FREQ=MONTHLY;INTERVAL=2;BYDAY=1MO;COUNT=4", "FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,TU", "FREQ=YEARLY;BYMONTHDAY=13;BYDAY=FR", "FREQ=MONTHLY;BYMONTHDAY=31", "FREQ=YEARLY;BYMONTH=3",
    "FREQ=DAILY;BYMONTH=7;INTERVAL=2", "FREQ=MONTHLY;BYDAY=SA,SU;BYSETPOS=1,-1;COUNT=6", "FREQ=MONTHLY;BYDAY=+1SU", "FREQ=WEEKLY;BYDAY=MO;BYSETPOS=1;COUNT=3",
]


def test_calendar_rules_give_the_dates_of_a_known_library(spark):
    firsts, low, high = [dt.date(2026, 1, 31), dt.date(2025, 11, 5), dt.date(2026, 5, 12)], dt.date(2026, 4, 1), dt.date(2027, 3, 31)
    rows = [(10 * i + j, r, f, low, high) for i, r in enumerate(RULES) for j, f in enumerate(firsts)]
    found = {}
    for x in recurrence.rrule_dates(spark.createDataFrame(rows, "k int, rule string, f date, low date, high date"), "k", "rule", "f", "low", "high").collect():
        found.setdefault(x.k, []).append(x.day)
    for k, r, f, _, _ in rows:
        dates = rrulestr(r, dtstart=dt.datetime.combine(f, dt.time())).between(dt.datetime.combine(low, dt.time()), dt.datetime.combine(high, dt.time()), inc=True)
        assert sorted(found.get(k, [])) == [x.date() for x in dates], (r, f)


@pytest.mark.parametrize("rule", ["FREQ=HOURLY", "FREQ=YEARLY;BYWEEKNO=20", "", "nonsense", None])
def test_rules_that_days_cannot_tell_have_none(spark, rule):
    rows = spark.createDataFrame([(1, rule, dt.date(2026, 1, 1), dt.date(2026, 1, 1), dt.date(2026, 2, 1))], "k int, rule string, f date, low date, high date")
    assert recurrence.rrule_dates(rows, "k", "rule", "f", "low", "high").count() == 0


# ---- feeds and portals

FEED = """<?xml version='1.0' encoding='ISO-8859-1'?><rss xmlns:ev="http://purl.org/rss/1.0/modules/event/" xmlns:xcal="urn:ietf:params:xml:ns:xcal"><channel>
<item><title>Märkte</title><ev:startdate>2026-07-05</ev:startdate><ev:location>Platz</ev:location><link>https://x.at/m</link><description>Say</description></item>
<item><title>Two</title><xcal:dtstart>2026-07-06T10:00</xcal:dtstart><xcal:dtend>2026-07-06T11:00</xcal:dtend></item>
<item><title>News</title><pubDate>Mon, 06 Jul 2026 10:00:00 GMT</pubDate><startDate>2026-07-05</startDate></item></channel></rss>"""
PORTAL = """<?xml version='1.0' encoding='ISO-8859-1'?><events>
<event id='1' freeofcharge='1'><title>Fest &amp;amp; Musik</title><description>&lt;p&gt;Ein  &amp;amp;quot;Fest&amp;amp;quot;&lt;/p&gt;</description><location>Grünmarkt</location><tags><tag> Märkte </tag><tag>Konzerte</tag></tags>
<link><url>https://other.at/1</url></link><link><url> https://www.linztermine.at/event/1 </url></link><date dFrom='2026-07-06 10:00:00' dTo='2026-07-06 12:00:00'/><date dFrom='2026-12-06 10:00:00'/><date dFrom='2026-07-04 11:59:59'/><date dFrom='2026-07-04 12:00:00' dTo='x'/></event>
<event><title> </title><date dFrom='2026-07-06 10:00:00'/></event>
<event><title>Bühnenfest</title><tags><tag>Bühne</tag></tags><date dFrom='2026-07-06 10:00'/><date dFrom='2026-07-07 10:00:00'/></event></events>"""


def test_feed(spark):
    market, two = read(landing.rss, spark, FEED)
    assert market == {"title": "Märkte", "starts_at": "2026-07-05", "venue_name": "Platz", "url": "https://x.at/m", "description": "Say"}
    assert two == {"title": "Two", "starts_at": "2026-07-06T10:00", "ends_at": "2026-07-06T11:00"}
    assert landing.rss_text(docs(spark, FEED)).first()["text"] == "Märkte\nSay\nhttps://x.at/m\n\n---\n\nTwo\n\n---\n\nNews"


def test_portal(spark):
    a, b, c = read(landing.portal_xml, spark, PORTAL, now="2026-07-05 12:00:00")
    assert a == {"title": "Fest & Musik", "description": 'Ein "Fest"', "venue_name": "Grünmarkt", "category": "market", "tags": ["Märkte", "Konzerte"], "url": "https://www.linztermine.at/event/1", "price_min": 0.0, "price_max": 0.0, "starts_at": "2026-07-06T10:00:00+02:00", "ends_at": "2026-07-06T12:00:00+02:00"}
    assert b["starts_at"] == "2026-07-04T12:00:00+02:00" and "ends_at" not in b
    assert c == {"title": "Bühnenfest", "category": "theatre", "tags": ["Bühne"], "starts_at": "2026-07-07T10:00:00+02:00"}


# ---- cascade, recipes, claims


def test_cascade(spark):
    """Each document once, by the first reader that finds something; text for a model only where none does."""
    js = '{"meta":1,"Sailings":[{"Name":"A","StartDate":"2031-07-05"},{"Name":"B","StartDate":"2031-07-06","Url":"https://x.at/b"},{"Name":"no date"}]}'
    long = "<html><script>x</script><p>" + "Nothing that a reader knows, but a long page. " * 4 + "</p></html>"
    both = ld({"@type": "Event", "name": "Inner", "startDate": "2026-07-05"})
    rows = docs(spark, js, ICS, ld({"@type": "Event", "name": "Gig", "startDate": "2026-07-05"}), FEED, PORTAL, "<p>nothing</p>", "{broken", long, None, "{" + long, both)
    rows = rows.withColumn("text", F.when(F.col("doc_id") == 8, F.lit("Words of a scanned leaflet, landed beside it. " * 4)))
    got = cascade.records(rows, "2026-07-05 12:00:00")
    assert sorted((r.doc_id, r.title, r.method, r.confidence) for r in got.where("tier < 5").collect()) == sorted([
        (0, "A", "json_api", 0.85), (0, "B", "json_api", 0.85), (1, "Long title, yes", "ics", 0.95), (1, "Days", "ics", 0.95), (2, "Gig", "jsonld", 0.95), (3, "Märkte", "rss", 0.9), (3, "Two", "rss", 0.9),
        (4, "Fest & Musik", "portal_xml", 0.95), (4, "Fest & Musik", "portal_xml", 0.95), (4, "Bühnenfest", "portal_xml", 0.95), (10, "Inner", "jsonld", 0.95),
    ])
    said = {r.doc_id: r.said for r in got.where("tier = 5").collect()}
    assert said.keys() == {7, 8, 9} and said[7].startswith("Nothing that") and said[8].startswith("Words of a scanned")
    assert got._jdf.queryExecution().toString().count("LogicalRDD") <= 4  # one scan, whatever the number of readers


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 8, 40])
def test_walk_is_that_of_a_queue(spark, cap):
    """Entries, then their next pages, each page once, up to the cap; cycles, missing pages and links into other listings."""
    rng = random.Random(cap)
    urls = [f"u{i}" for i in range(60)]
    following = {u: rng.choice([*urls, None, "lost"]) for u in urls}
    for i in range(40, 59):
        following[f"u{i}"] = f"u{i + 1}"  # a long chain
    bodies = {u: f"body {i}" for i, u in enumerate(urls) if i != 17}
    entries = {r: rng.sample(urls, n) for r, n in ((1, 1), (2, 3), (3, 9))} | {4: ["u40"], 5: ["lost"]}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    visited, report = recipes.walk(
        table([(r, p, u) for r, us in entries.items() for p, u in enumerate(us)], "recipe_id int, place int, url string"), table([(u, v) for u, v in following.items() if v], "url string, next_url string"),
        table([(u, i, b) for i, (u, b) in enumerate(bodies.items())], "url string, doc_id long, body string"), table([(r, cap) for r in entries], "recipe_id int, page_cap int"),
    )
    want, ends = set(), {}
    for r, us in entries.items():
        queue, seen, n = list(us), set(), 0
        while queue and n < cap:
            u = queue.pop(0)
            if u in seen or u not in bodies:
                continue
            seen.add(u)
            n += 1
            want.add((r, n, u))
            queue += [following[u]] if following[u] else []
        if n:
            ends[r] = "cap" if any(u not in seen and u in bodies for u in queue) else "exhausted"
    assert {(x.recipe_id, x.number, x.url) for x in visited.collect()} == want
    assert {x.recipe_id: x.stop for x in report.collect()} == ends


def test_links_that_lead_nowhere(spark):
    pages = spark.createDataFrame([(0, "a", "same"), (1, "b", "same"), (2, "c", "same"), (3, "x", "one"), (4, "y", "two")], "doc_id long, url string, body string")
    entries = spark.createDataFrame([(1, 0, "a"), (2, 0, "x")], "recipe_id int, place int, url string")
    _, report = recipes.walk(entries, spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "url string, next_url string"), pages, spark.createDataFrame([(1, 9), (2, 9)], "recipe_id int, page_cap int"))
    assert {r.recipe_id: (r.n_pages, r.stop) for r in report.collect()} == {1: (3, "noop"), 2: (2, "exhausted")}


def test_walk_of_few_listings_deals_links_once(spark, monkeypatch):
    """Links are written once, however long the walk; each step writes no more rows than there are listings. Doubling gives the same walk."""
    pages = spark.range(400).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("doc_id"), F.concat(F.lit("body "), "id").alias("body"))
    links = spark.range(399).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("u"), F.col("id") + 1).alias("next_url"))
    entries = spark.createDataFrame([(1, 0, "u0"), (1, 1, "u100"), (2, 0, "u395"), (3, 0, "lost")], "recipe_id int, place int, url string")
    caps = spark.createDataFrame([(1, 20), (2, 9), (3, 5)], "recipe_id int, page_cap int")
    made = []
    monkeypatch.setattr(recipes, "written", lambda df, name: (made.append((name, df.count())), written(df, name))[1])
    walks = lambda: [{tuple(r) for r in x.collect()} for x in recipes.walk(entries, links, pages, caps)]
    by_steps = walks()
    assert [n for name, n in made if name == "recipe-links"] == [399]
    assert {r[5] for r in by_steps[0] if r[0] == 1} == set(range(1, 21)) and {(r[0], r[1], r[4]) for r in by_steps[1]} == {(1, 20, "cap"), (2, 5, "exhausted")}
    monkeypatch.setattr(recipes, "STEPS", 0)
    assert walks() == by_steps


def test_pages_of_a_recipe(spark):
    page = '<a class="next" href="?p=2">on</a><a class="next" href="?p=9">x</a>'
    own = '<a class="next" href="/list">here</a>'
    assert [r.next_url for r in landing.next_pages(docs(spark, page, own), "a.next").collect()] == ["https://x.at/list?p=2"]
    pages = [(1, "l", p, prints, last) for p, prints, last in [(0, ["a"], None), (1, ["b"], None), (2, [], None), (3, ["a"], None), (4, ["b"], None), (5, ["a", "b"], None), (6, ["z"], None)]]
    pages += [(2, "l", 0, ["z"], dt.date(2026, 7, 9)), (2, "l", 1, ["z"], dt.date(2026, 7, 1)), (2, "l", 2, ["z"], None), (3, "l", 0, ["z"], None)]
    table = spark.createDataFrame(pages, "recipe_id int, listing string, page int, prints array<string>, last_day date")
    got = landing.worth_following(table, spark.createDataFrame([("a",), ("b",)], "print string"), F.lit("2026-07-05"))
    assert {(r.recipe_id, r.last_page, r.stopped) for r in got.collect()} == {(1, 5, True), (2, 1, True), (3, 0, False)}
    records = spark.createDataFrame([(1, 0, "A", "2026-07-05", None, 0.85), (1, 1, "A", "2026-07-05", None, 0.85), (1, 1, "B", "2026-07-06", "https://b.at", 0.85), (1, 1, "B", "soon", None, 0.85)], "recipe_id int, doc_id long, title string, starts_at string, url string, confidence double")
    with_url = landing.with_page_url(records, docs(spark, "", "").withColumn("url", F.concat("url", "doc_id")), F.col("doc_id") == 1)
    got = landing.unique_records(with_url)
    assert {(r.title, r.starts_at, r.url, r.url_confidence) for r in got.collect()} == {("A", "2026-07-05", "https://x.at/list1", 0.6), ("B", "2026-07-06", "https://b.at", 0.85), ("B", "soon", "https://x.at/list1", 0.6)}
    checked = landing.validated(got).first()
    assert (checked.n_items, round(checked.parsed, 3), checked.has_title, checked.ok) == (3, 0.667, 1.0, False)


def test_claims_from_records(spark):
    js = json.dumps([
        {"name": "Jazz &amp;amp; Wein 🎷 – ausverkauft", "start": "20. Juli 2026, 19:00 Uhr", "description": "Konzertbeginn: 20:00 Uhr", "url": "www.x.at", "price": 1840}, {"name": "Gone", "start": "2026-01-01"}, {"name": "Club Programm 2026", "start": "2026-07-21"},
        {"name": "Betriebsurlaub", "start": "2026-07-21"}, {"name": "Kurs", "start": "2026-07-21", "price": 20, "link": "https://x.at/k"},
    ])
    pages = docs(spark, js).withColumns({"source_id": F.lit(7), "fetched_at": F.lit(dt.datetime(2026, 7, 5))})
    sources = spark.createDataFrame([(7, "Club", 0.8, 48.31, 14.29)], "source_id int, source_name string, trust double, lat double, lon double")
    got = {r.title: r for r in landing.claims(landing.json_api(pages), pages, sources, F.lit(dt.datetime(2026, 7, 5, 12))).collect()}
    assert set(got) == {"Jazz & Wein", "Kurs"}
    jazz = got["Jazz & Wein"]
    assert jazz.starts_at == dt.datetime(2026, 7, 20, 18) and jazz.url is None and jazz.price_min is None and jazz.confidence == 0.85 and jazz.fingerprint == "jazz wein|2026-07-20|9662:1901"
    assert got["Kurs"].price_min == 20 and got["Kurs"].url == "https://x.at/k" and len({r.claim_id for r in got.values()}) == 2
