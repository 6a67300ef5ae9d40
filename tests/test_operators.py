"""Meaning of the operators on small tables."""

import datetime as dt
import hashlib
import re
import unicodedata
import random

import pytest
from pyspark.sql import functions as F

from evidenceloom.functions import geo, similarity, stemming, text, timeutil
from evidenceloom.operators import blocking, components, evidence, recurrence, tagmatch, venues
from evidenceloom.plans import canon, control, present, search
from evidenceloom.sources import landing, ledger, tables

NOW = dt.datetime(2026, 7, 5, 12, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("title", "want"),
    [("Der Frühling & die Straße", "fruehling strasse"), ("Kinderkurs 3 (OmdtU)", "kinderkurs 3"), ("Café Été", "cafe ete"), ("", ""), ("日本 fest", "fest")],
)
def test_titles(spark, title, want):
    assert one(spark, text.normalize_title(lit(title))) == want


def test_placeholders_and_notices(spark):
    assert one(spark, text.is_placeholder(lit("Kupferhof Events 2026"), lit("Kupferhof")))
    assert not one(spark, text.is_placeholder(lit("Kupferhof Jazz"), lit("Kupferhof")))
    assert one(spark, text.is_non_event(lit("Wiedereröffnung am Montag")))
    assert not one(spark, text.is_non_event(lit("Wiedereröffnungsfeier")))


def test_title_cleaning(spark):
    assert one(spark, text.clean_title(lit("Jazz Night 🎷 - Posthof Linz"), lit("Posthof"))) == "Jazz Night"
    assert one(spark, text.clean_title(lit("Big Show – fast ausverkauft"), lit(None).cast("string"))) == "Big Show"
    assert one(spark, text.clean_text(lit("A &amp;amp; B\n &quot;C&quot;"))) == 'A & B "C"'
    assert one(spark, text.clean_text(lit("Caf&eacute; &#8211; &#x41;&hellip; 5 &gt 3 &nosuch;"))) == "Café – A… 5 > 3 &nosuch;"
    rows = spark.createDataFrame([("Kinder&amp;Kunst - Posthof Linz", "Posthof"), ("Plain", None), (None, "x"), ("Linz", "Linz"), ("Tour Tour", "Tour")], "t string, v string")
    got = [r[0] for r in rows.select(text.clean_title(text.clean_text(F.col("t")), F.col("v"))).collect()]
    assert got == ["Kinder&Kunst", "Plain", None, "Linz", "Tour"]


@pytest.mark.parametrize("value", ["ﬁnale №5 Ｆｕｌｌ", "Phở ½ Tiếng x²", "Ødegård ægir", "caf\u0065\u0301", "x…b", "Ⅷ ㎏ ™", "Ǆ ŉ ĳ ☎ 音楽", "𝔊𝔬𝔱𝔥 𝟙𝟚", "ÄÖÜ ẞ ß"])
def test_titles_are_folded_by_compatible_decomposition(spark, value):
    plain = value.lower()
    for umlaut, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = plain.replace(umlaut, spelled)
    plain = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode()
    want = " ".join(w for w in re.sub("[^a-z0-9]+", " ", plain).split() if w not in text.STOP_WORDS)
    assert one(spark, text.normalize_title(lit(value))) == want


def test_explicit_start(spark):
    at = lambda *x: dt.datetime(2026, 7, 20, *x)
    said = "Karten ab 19:00 Uhr. Einlass: 19:30 Uhr. Konzertbeginn: 20:00 Uhr."
    start = lambda t, d, bare=False: one(spark, text.explicit_start(lit(t).cast("timestamp"), lit(d).cast("string"), lit(bare)).cast("string"))
    assert start(at(17), said) == "2026-07-20 18:00:00"
    assert start(at(8), said) == "2026-07-20 08:00:00" and start(at(8), said, True) == "2026-07-20 18:00:00"
    assert start(at(17), "Vorstellungsbeginn 27:80") == start(at(17), None) == "2026-07-20 17:00:00"


@pytest.mark.parametrize(
    ("word", "want"),
    [("konzerte", "konzert"), ("aufeinander", "aufeinand"), ("kategorischen", "kategor"), ("kleinlichkeit", "kleinlich"), ("jahrhunderte", "jahrhundert"), ("häuser", "haus"), ("ausstellungen", "ausstell"), ("veranstaltung", "veranstalt"), ("freuen", "freu"), ("kenntnisse", "kenntnis"), ("linz", "linz"), ("musik", "musik"), ("größe", "gross")],
)
def test_stems(word, want):
    assert stemming.stem(word) == want


def test_query_words():
    assert stemming.stemmed("Die Konzerte und das Konzert im Park 2026, oder nicht?") == ["2026", "konzert", "park"]
    assert stemming.stemmed("die der das") == []


def test_compound_names_end_in_the_word(spark):
    hit = lambda t, n: one(spark, lit(t).rlike(text.compound_name_pattern(n)))
    assert hit("Großer Maturaball 2026", "ball") and hit("Poetry-Slam", "poetry slam") and not hit("Ballett", "ball")


def test_private_addresses(spark):
    yes = lambda a, o: one(spark, text.is_private(lit(a), lit(o)))
    assert yes("Hauptstraße 12", "Anna Maier") and not yes("Hauptstraße 12", "Verein Linz") and not yes("Stadtpark", "Anna Maier") and not yes("Hauptstraße 12", None)


def test_title_similarity(spark):
    def sim(a, b):
        side = lambda t: (similarity.trigrams(text.normalize_title(lit(t))), text.title_words(lit(t)))
        return one(spark, similarity.title_similarity(*side(a), *side(b)))

    assert sim("Jazz im Park", "Jazz im Park") == 1.0
    assert sim("Mira Holler", "Sommerklang Festival 2026 - Mira Holler") == 0.72
    assert sim("Jazz", "Jazz Brunch Sonntag Spezial") == 0.60
    assert sim("", "") == 1.0


def test_classes(spark):
    assert [one(spark, similarity.classify(lit(x))) for x in (0.81, 0.80, 0.50, 0.49)] == ["merge", "adjudicate", "adjudicate", "distinct"]


def test_token_similarity(spark):
    sim = lambda t, w: one(spark, similarity.token_similarity(lit(t), lit(w)))
    assert sim("konzert", "konzert") == 1.0 and sim("konzert", "gartenkonzerte") == 0.75 and sim("woche", "wochentagsmesse") < 0.75


def test_cells_round_halves_to_even(spark):
    assert one(spark, geo.geo_cell(lit(0.0125), lit(0.0))) == "2:0"
    assert one(spark, geo.geo_cell(lit(None).cast("double"), lit(1.0))) == ""


def test_default_circle_keeps_unknown_places(spark):
    none = lit(None).cast("double")
    assert one(spark, geo.default_gate(none, none))
    assert not one(spark, F.coalesce(geo.within(none, none, geo.CENTER, 5000), lit(False)))


@pytest.mark.parametrize(("days", "cadence", "want"), [(0, 7, 1.0), (8, 7, 0.9), (15, 7, 0.81), (10_000, 7, 0.9**50), (30, 0, 1.0)])
def test_decay(spark, days, cadence, want):
    got = one(spark, timeutil.effective_confidence(lit(1.0), lit(NOW - dt.timedelta(days=days)), lit(NOW), lit(cadence)))
    assert got == pytest.approx(want)


def test_decay_without_confirmation(spark):
    assert one(spark, timeutil.effective_confidence(lit(0.7), lit(None).cast("timestamp"), lit(NOW), lit(7))) == 0.7


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2026-07-21T09:00:00", "2026-07-21 07:00:00"), ("21. Jul. 2026, 09:00 Uhr", "2026-07-21 07:00:00"), ("2026-01-05", "2026-01-04 23:00:00"), ("3. März 2026", "2026-03-02 23:00:00"),
        ("2026-07-21T09:00:00Z", "2026-07-21 09:00:00"), ("someday", None), ("3. März 2027, 18:30 Uhr", "2027-03-03 17:30:00"), ("21. Jul. 2026 – 22. Jul. 2026", "2026-07-20 22:00:00"),
        ("Tue, 21 July 2026 19:30", "2026-07-21 17:30:00"), ("July 21, 2026 7:30 PM", "2026-07-21 17:30:00"), ("20260721T193000", "2026-07-21 17:30:00"), ("2026-07-21T19:30:00.250+02:00", "2026-07-21 17:30:00.25"),
        ("2026-13-41", None), ("", None), (None, None),
    ],
)
def test_times(spark, value, want):
    assert one(spark, timeutil.parse_time(lit(value).cast("string")).cast("string")) == want


# ---- evidence


def claims(spark, rows):
    return spark.createDataFrame(rows, "event_id int, source_id int, claim_id int, trust double, confidence double, extracted_at int, status string")


def test_independent_sources_compound(spark):
    c = claims(spark, [(1, s, s, 0.8, 0.95, s, "scheduled") for s in range(3)])
    v = evidence.noisy_or(c, ["event_id"], "source_id", F.col("trust") * F.col("confidence")).first()["confidence"]
    assert v == pytest.approx(1 - (1 - 0.76) ** 3)
    more = c.union(claims(spark, [(1, 9, 9, 0.1, 0.5, 9, "scheduled")]))
    assert evidence.noisy_or(more, ["event_id"], "source_id", F.col("trust") * F.col("confidence")).first()["confidence"] >= v


def fold_status(rows):
    """The rule as it is told: in order of time, a trusted negative sets, a later other one of enough trust clears."""
    held, trust = "scheduled", 0.0
    for _, _, _, t, _, _, status in sorted(rows, key=lambda r: (r[5], r[2])):
        if status == "cancelled" and t > 0.5:
            held, trust = status, t
        elif status != "cancelled" and held != "scheduled" and t >= trust:
            held, trust = "scheduled", 0.0
    return held


def test_status_by_closed_form(spark):
    """The last trusted negative and what clears it, against the sequential rule; times differ."""
    rng = random.Random(4)
    rows = [(e, i % 5, 100 * e + i, rng.choice([0.3, 0.55, 0.7, 0.9]), 1.0, i, rng.choice(["scheduled", "cancelled", "scheduled"])) for e in range(60) for i in range(rng.randrange(1, 9))]
    got = {r.event_id: r.status for r in evidence.merge_status(claims(spark, rows), ["event_id"]).collect()}
    assert got == {e: fold_status([r for r in rows if r[0] == e]) for e in {r[0] for r in rows}}


def test_field_merge_prefers_weight_then_length(spark):
    f = spark.createDataFrame([(1, "title", "Jazz", 0.5, 1), (1, "title", "Jazz Night", 0.5, 2), (1, "price", "9", 0.4, 1), (1, "price", "10", 0.4, 2), (1, "url", None, 0.9, 3)], "event_id int, field string, value string, weight double, claim_id int")
    assert {(r.field, r.value, r.claim_id) for r in evidence.merge_fields(f, ["event_id"]).collect()} == {("title", "Jazz Night", 2), ("price", "10", 2)}


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in label}


def test_blocks_of_too_many_say_nothing(spark):
    rows = spark.createDataFrame([(i, ["common", f"k{i // 2}"]) for i in range(10)], "n int, keys array<string>")
    assert {tuple(r) for r in blocking.candidate_pairs(rows, "n", "keys", 5).collect()} == {(2 * i, 2 * i + 1) for i in range(5)}


# ---- calendars


def days(spark, rows):
    return spark.createDataFrame([(k, dt.date(2026, 1, 5) + dt.timedelta(days=d)) for k, ds in rows.items() for d in ds], "k string, day date")


def test_cadence(spark):
    rows = {"weekly": [0, 7, 14, 21], "fortnightly": [0, 14, 28], "jitter": [0, 8, 14, 21], "skip": [0, 7, 21, 28], "two skips": [0, 14, 21, 35, 42, 56, 57], "few": [0, 7], "odd": [0, 3, 11]}
    got = {r.k: r.cadence for r in recurrence.cadence(days(spark, rows), ["k"]).collect()}
    assert got == {"weekly": 7, "fortnightly": 14, "jitter": 7, "skip": 7, "two skips": None, "few": None, "odd": None}


def test_projection_begins_after_what_is_covered(spark):
    found = recurrence.cadence(days(spark, {"a": [0, 7, 14]}), ["k"]).withColumn("edge", F.date_add("last_day", 10))
    assert [(r.projected_day - dt.date(2026, 1, 19)).days for r in recurrence.project(found, "edge").orderBy("projected_day").collect()] == [14, 21, 28]


def test_rules_hold_across_the_change_of_the_clock(spark):
    rule = spark.sql("SELECT 'weekly' freq, 'SU' weekday, null week_of_month, 1 interval, date'2026-03-22' valid_from, cast(null as date) valid_until, 600 minutes, date'2026-03-20' a, date'2026-04-06' b")
    dates = recurrence.rule_dates(rule, "a", "b").select(recurrence.local_start(F.col("day"), F.col("minutes")).cast("string").alias("t")).orderBy("t")
    assert [r.t for r in dates.collect()] == ["2026-03-22 09:00:00", "2026-03-29 08:00:00", "2026-04-05 08:00:00"]


def test_rrule(spark):
    r = one(spark, recurrence.parse_rrule(lit("FREQ=MONTHLY;BYDAY=-1FR,MO;INTERVAL=2;UNTIL=20261231T000000Z;BYMONTHDAY=1,-1;WKST=SU")))
    assert (r.freq, r.every, r.until, r["count"], r.days, r.month_days, r.week_start) == ("MONTHLY", 2, dt.date(2026, 12, 31), None, [(-1, 4), (None, 0)], [1, -1], 6)


def test_fold(spark):
    at = lambda h, d=6: dt.datetime(2026, 7, d, h)
    rows = [(1, at(19), at(23), True), (1, at(19), at(21), True), (1, at(19), None, True), (1, at(0), None, False), (1, at(0, 8), None, False), (1, at(0, 8), at(22, 8), False)]
    got = {(r.starts_at, r.ends_at, r.timed) for r in recurrence.fold(spark.createDataFrame(rows, "k int, starts_at timestamp, ends_at timestamp, timed boolean"), ["k"]).collect()}
    assert got == {(at(19), at(21), True), (at(0, 8), at(22, 8), False)}


# ---- search


def rows(spark):
    c = "event_id string, occurrence_id string, title string, starts_at timestamp, ends_at timestamp, status string, lat double, lon double, category array<string>, price_min double, confidence double, venue_name string, organizer string, sex_service_context boolean, kid_friendly boolean, kid_friendly_conf double"
    near, far = (48.31, 14.29), (47.0, 13.0)
    t = lambda d: NOW + dt.timedelta(days=d)
    base = [
        ("near", "o1", "Jazz Ball", t(1), None, "scheduled", *near, ["music"], 0.0, 0.9, "Posthof", None, None, True, 0.8),
        ("far", "o2", "Jazz", t(1), None, "scheduled", *far, ["music"], 5.0, 0.9, None, None, None, False, 0.8),
        ("nowhere", "o3", "Film", t(2), None, "scheduled", None, None, [], None, 0.5, None, None, True, None, None),
        ("past", "o4", "Old", t(-3), None, "scheduled", *near, ["music"], None, 0.9, None, None, None, None, None),
        ("ongoing", "o5", "Show", t(-1), t(3), "scheduled", *near, ["art"], 30.0, 0.7, None, None, None, None, None),
        ("moved", "o6", "Moved", t(1), None, "moved", *near, ["music"], None, 0.9, None, None, None, None, None),
        ("ongoing", "o7", "Show", t(2), None, "scheduled", *near, ["art"], 30.0, 0.7, None, None, None, None, None),
    ]
    return spark.createDataFrame(base, c)


@pytest.mark.parametrize(
    ("f", "want"),
    [
        ({}, {"near", "nowhere", "ongoing"}),
        ({"radius": "any"}, {"near", "far", "nowhere", "ongoing"}),
        ({"near": (48.31, 14.29)}, {"near", "ongoing"}),
        ({"category": ("music",)}, {"near"}),
        ({"exclude_category": ("music",)}, {"nowhere", "ongoing"}),
        ({"max_price": 10.0, "radius": "any"}, {"near", "far"}),
        ({"is_free": True}, {"near"}),
        ({"is_free": False}, {"near", "nowhere", "ongoing"}),
        ({"name": "ball"}, {"near"}),
        ({"exclude_terms": ("jazz",)}, {"nowhere", "ongoing"}),
        ({"required": ("kid_friendly",), "wanted": {"kid_friendly": True}}, {"near"}),
        ({"required": ("kid_friendly",)}, {"near", "nowhere", "ongoing"}),
        ({"venue": "posthof"}, {"near"}),
    ],
)
def test_hard_filters(spark, f, want):
    assert {r.event_id for r in search.hard(rows(spark), search.Filters(**f), F.lit(NOW)).collect()} == want


def test_listing_keeps_moved_rows(spark):
    assert "moved" in {r.event_id for r in search.hard(rows(spark), search.Filters(), F.lit(NOW), statuses="listed").collect()}


def test_known_sensitive_rows_are_hidden(spark):
    assert "nowhere" not in {r.event_id for r in search.hard(rows(spark), search.Filters(), F.lit(NOW), hide_sensitive=True).collect()}


def test_query_ranks_by_certainty(spark):
    f = search.Filters(radius="any", wanted={"kid_friendly": True})
    got = search.run(rows(spark), f, F.lit(NOW)).collect()
    assert [(r.event_id, r.match_score) for r in got] == [("near", 0.9), ("ongoing", 0.45), ("nowhere", 0.45), ("far", 0.1)]
    assert next(r for r in got if r.event_id == "ongoing").occurrence_id == "o7"


def test_filters_are_checked():
    for bad in ({"radius": "wide"}, {"category": ("fun",)}, {"required": ("price",)}, {"min_tag_match": 0.5}, {"wanted": {"mood": 1}}, {"weekdays": ("someday",)}):
        with pytest.raises(ValueError):
            search.Filters(**bad)


def test_cursor_round_trip():
    key = (dt.datetime(2026, 1, 2, 3, 4, 5), "abc")
    assert search.decode_cursor(search.encode_cursor(*key)) == key
    assert search.decode_cursor("2026-01-02T03:04:05|abc") == key


def test_lexical_search_fails_closed(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["gartenkonzert im park", *(f"messe{i} linz" for i in range(12))])], "id int, t string")
    find = lambda *q: [r.id for r in search.lexical(d, text.haystack(F.col("t")), "id", list(q)).collect()]
    assert find("konzert", "linz") == [0] and find("xqzv", "yqzw", "linz") == [] and find() == []


# ---- tags


def test_tag_match(spark):
    e = lambda x: [x, (1 - x * x) ** 0.5]
    tags = spark.createDataFrame([(1, "jazz", 0.8, e(1.0)), (1, "dance", 0.6, e(0.0)), (2, "jazz", 0.9, e(1.0)), (3, "plain", 0.9, None)], "event_id int, name string, confidence double, vector array<double>")
    two = spark.createDataFrame([(0, "jazz", e(1.0)), (1, "dance", e(0.0)), (-1, "jazz dance", e(0.7))], "concept int, name string, vector array<double>")
    got = {r.event_id: (r.coverage, r.match) for r in tagmatch.match(tags, two, 2).collect()}
    assert got[1][0] == pytest.approx(2 / (1 / 0.8 + 1 / 0.6))
    assert 0.9 * got[1][0] <= got[1][1] <= got[1][0]
    assert got[2][0] < 0.1 and got[3] == (0.0, 0.0)


# ---- sources


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b, "https://x.at/list") for i, b in enumerate(bodies)], "doc_id long, body string, url string")


def test_selectors(spark):
    page = "<div class='e'><h2>One</h2><a class='more' href='/1'>x</a></div><div class='e big'><h2>Two <b>!</b></h2></div><div class='e'></div>"
    got = landing.with_selectors(docs(spark, page), "div.e", {"title": "h2", "url": "a.more @href"}).orderBy("title").collect()
    assert [(r.title, r.url) for r in got] == [("One", "https://x.at/1"), ("Two !", None)]
    assert [r.link for r in landing.links(docs(spark, page), "div.e a").collect()] == ["https://x.at/1"]


def test_upsert_and_swap(spark, tmp_path):
    t = lambda *r: spark.createDataFrame(list(r), "k int, v string, n int")
    keep = tables.upsert(t((1, "a", 1)), t((1, "b", 1), (2, "c", 2), (2, "d", 1)), ["k"], [F.col("n")], update=False)
    assert {(r.k, r.v) for r in keep.collect()} == {(1, "a"), (2, "d")}
    assert {(r.k, r.v) for r in tables.upsert(t((1, "a", 1)), t((1, "b", 1)), ["k"], [F.col("n")]).collect()} == {(1, "b")}
    v = tables.Versioned(spark, f"file://{tmp_path}/canon")
    assert v.current() is None and v.number() == 0
    v.swap(t((1, "a", 1)))
    v.swap(t((2, "b", 1)))
    assert [r.k for r in v.read().collect()] == [2]


def test_files_for_people(spark, tmp_path):
    asked = spark.createDataFrame([("k1", "a", "b")], "key string, a string, b string")
    proposals = spark.createDataFrame([("1", 'Saal "x", Linz', "review"), ("2", "y", "alias")], "venue string, name string, proposal string")
    tables.text_file(tables.review_list(asked, proposals), f"file://{tmp_path}/review")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/review").collect()] == ["same? a <> b [k1]", 'venue? 1 <> Saal "x", Linz']
    tables.csv_file(proposals.orderBy("venue"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv").collect() == [("1", 'Saal "x", Linz', "review"), ("2", "y", "alias")]


def test_wanted_tags():
    assert search.desired(["Live  Music", "jazz", "live music"]) == ("live music", "jazz")
    for bad in ([""], ["a b c d"], ["x" * 61], ["a (b)"], [f"t{i}" for i in range(9)]):
        with pytest.raises(ValueError):
            search.desired(bad)
    with pytest.raises(ValueError):
        search.feed_only(None, least=5, most=2)


def test_too_many_concepts(spark):
    tags = spark.createDataFrame([(1, "jazz", 0.8, [1.0])], "event_id int, name string, confidence double, vector array<double>")
    many = spark.createDataFrame([(i, f"c{i}", [1.0]) for i in range(10)], "concept int, name string, vector array<double>")
    with pytest.raises(ValueError, match="concepts"):
        tagmatch.match(tags, many, 8)


# ---- control plane and presentation


def test_streaks(spark):
    log = spark.createDataFrame([(s, i, k) for s, ks in {"bad": "eeeee", "few": "ee", "ok": "eeeeo"}.items() for i, k in enumerate(ks)], "s string, i int, k string")
    assert {r.s: r.streak for r in control.last_n(log, "s", [F.col("i").desc()], 5, F.col("k") == "e").collect()} == {"bad": True, "few": False, "ok": False}


def test_scale(spark):
    got = one(spark, present.scale(lit(100), lit(0.2), lit(None).cast("int"), lit(None).cast("int")))
    assert (got.plausible_min, got.plausible_max, got.band) == (60, 140, "medium")
    assert one(spark, present.scale(lit(100), lit(0.9), lit(90), lit(120))).plausible_min == 90


def test_venues(spark):
    known = spark.createDataFrame([(1, "Brucknerhaus Linz", ["Brucknerhaus"], 48.31, 14.29), (2, "Posthof", [], None, None)], "venue_id long, name string, aliases array<string>, lat double, lon double")
    names = spark.createDataFrame([("brucknerhaus", None, None), ("Brucknerhaus Linz Saal", None, None), ("Brucknerhaus Linz West", 47.0, 13.0), ("Linz", None, None), ("Posthof", None, None), ("Neue Halle", None, None)], "name string, lat double, lon double")
    got = {r.name: (r.venue_id, r.how) for r in venues.resolve(names, known).collect()}
    assert got == {"brucknerhaus": (1, "exact"), "Brucknerhaus Linz Saal": (1, "fuzzy"), "Brucknerhaus Linz West": (None, "new"), "Linz": (None, "generic"), "Posthof": (2, "exact"), "Neue Halle": (None, "new")}


# ---- canon

CLAIM = (
    "claim_id string, source_id int, source_name string, trust double, extracted_at timestamp, title string, starts_at timestamp, ends_at timestamp, venue_name string, address string, lat double, lon double, organizer string, url string, description string, "
    "category string, price_min double, price_max double, status string, confidence double, recurrence struct<freq: string, weekday: string, week_of_month: int, interval: int, valid_from: date, valid_until: date, except_holidays: array<string>, minutes: int, duration_minutes: int>"
)


def claim(n, source, title, starts, venue="Posthof", status=None, **more):
    r = {"address": None, "organizer": None, "url": None, "category": "music", "price": None} | more
    return (f"c{n}", source, f"source {source}", 0.8, NOW - dt.timedelta(hours=n), title, starts, None, venue, r["address"], None, None, r["organizer"], r["url"], None, r["category"], r["price"], None, status, 0.95, None)


def build(spark, rows_, series=(), identity=None, read_rules=None, estimates=None):
    rule = CLAIM[CLAIM.index("struct<") :]
    if read_rules is not None:
        read_rules = spark.createDataFrame(read_rules, f"content_key string, recurrence {rule}")
    if estimates is not None:
        estimates = spark.createDataFrame(estimates, "content_key string, price_basis string, price_evidence string, price_conf double, age_conf double, age_lo int, age_hi_excl int, cached boolean")
    empty = lambda s: spark.createDataFrame([], s)
    return canon.rebuild(
        spark.createDataFrame(rows_, CLAIM), empty("venue_id long, name string, aliases array<string>, lat double, lon double"), empty("kind string, starts_on date, ends_on date"), identity or empty("fingerprint string, event_id string, first_seen timestamp"),
        empty("key string, same boolean"), empty("event_id string, verified boolean"), spark.createDataFrame(list(series), "event_id string, verdict string"), F.lit(NOW), read_rules, estimates,
    )


def test_three_sources_make_one_event(spark):
    at = NOW + dt.timedelta(days=3)
    log = [claim(i, i, "Jazz im Hof", at) for i in range(3)] + [claim(9, 1, "Lesung", at, venue="Haus der Bücher"), claim(10, 2, "Betriebsurlaub", at)]
    c = build(spark, log)
    got = {r.title: r for r in c.events.collect()}
    assert set(got) == {"Jazz im Hof", "Lesung"} and got["Jazz im Hof"].confidence > 0.9 and got["Jazz im Hof"].n_sources == 3
    assert c.occurrences.count() == 2
    rng = random.Random(0)
    again = build(spark, rng.sample(log, len(log)))
    key = lambda df: sorted(map(tuple, df.select("event_id", "title", F.round("confidence", 9)).collect()))
    assert key(again.events) == key(c.events)
    assert sorted(r.occurrence_id for r in again.occurrences.collect()) == sorted(r.occurrence_id for r in c.occurrences.collect())


def test_series_are_projected_only_when_judged(spark):
    log = [claim(i, 1, "Zumba", NOW - dt.timedelta(days=21 - 7 * i)) for i in range(3)]
    c = build(spark, log)
    assert c.events.count() == 1 and not c.occurrences.where("projected").count()
    event = c.events.first()["event_id"]
    assert build(spark, log, [(event, "recurring")]).occurrences.where("projected").count() == 4
    assert not build(spark, log, [(event, "not_an_event")]).occurrences.count()


def test_a_twin_without_place_joins_the_series(spark):
    log = [claim(i, 1, "Zumba", NOW + dt.timedelta(days=7 * i)) for i in range(3)] + [claim(7, 2, "Zumba", NOW + dt.timedelta(days=7), venue=None)]
    assert build(spark, log).events.count() == 1


def by_turns(groups, known):
    """Identity group by group in their turn: event of each group, and of each print in the end. groups: {group: prints}; known: {print: (event, first_seen)}."""
    age = {}
    for e, seen in known.values():
        age[e] = min(age.get(e, seen), seen)
    owns = {g: {known[p][0] for p in prints if p in known} for g, prints in groups.items()}
    oldest = {g: min(es, key=lambda e: (age[e], e)) for g, es in owns.items() if es}
    turn = sorted(oldest, key=lambda g: (age[oldest[g]], oldest[g], min(groups[g]), g))
    now, taken, event = {p: e for p, (e, _) in known.items()}, set(), {}
    for g in turn:
        owners = sorted({now[p] for p in groups[g] if p in now}, key=lambda e: (age.get(e, NOW), e))
        first = owners[0]
        if first in taken or any(e in taken for e in owners):
            event[g] = ("split", oldest[g], min(groups[g]))
            for e in owners:
                if e not in taken:  # what it holds alone goes with it
                    now = {p: event[g] if x == e else x for p, x in now.items()}
        else:
            event[g] = first
            now = {p: first if x in owners else x for p, x in now.items()}
        taken.add(event[g])
        age.setdefault(event[g], NOW)
        now |= dict.fromkeys(groups[g], event[g])
    for g in groups.keys() - oldest.keys():
        event[g] = ("event", min(groups[g]))
        now |= dict.fromkeys(groups[g], event[g])
    return event, now


@pytest.mark.parametrize("seed", range(4))
def test_identity_takes_turns(spark, seed):
    """Many small snapshots side by side, each with merges, splits, prints that are gone and new ones, against the sequential procedure."""
    rng = random.Random(seed)
    groups, known = {}, {}
    for world in range(60):
        prints = [f"w{world}p{i}" for i in range(9)]
        for p in prints:
            g = rng.choice([None, 0, 0, 1, 2])
            if g is not None:
                groups.setdefault(f"w{world}g{g}", set()).add(p)
            if rng.random() < 0.7:
                known[p] = (f"w{world}e{rng.choice([0, 0, 1, 2])}", NOW - dt.timedelta(days=rng.randrange(40)))
    event, now = by_turns(groups, known)
    got = canon.identify(
        spark.createDataFrame([(g, p, NOW) for g, ps in groups.items() for p in ps], "group string, fingerprint string, extracted_at timestamp"),
        spark.createDataFrame([(p, e, s) for p, (e, s) in known.items()], "fingerprint string, event_id string, first_seen timestamp"),
    ).collect()
    md5 = lambda *x: hashlib.md5("\n".join(x).encode()).hexdigest()
    want = {p: e if isinstance(e, str) else md5(*e) for p, e in now.items()}
    assert {r.fingerprint: r.event_id for r in got} == want
    assert {r.fingerprint: r.first_seen for r in got} == {p: known[p][1] if p in known else NOW for p in now}
    ids = {g: {want[p] for p in ps} for g, ps in groups.items()}
    assert all(len(x) == 1 for x in ids.values()) and len({min(x) for x in ids.values()}) == len(groups)
    assert {md5(*e) if not isinstance(e, str) else e for e in event.values()} == {min(x) for x in ids.values()}


def test_a_series_keeps_its_event_when_its_old_dates_are_gone(spark):
    first = [claim(i, 1, "Zumba", NOW + dt.timedelta(days=7 * i - 60)) for i in range(3)]
    later = [claim(10 + i, 1, "Zumba", NOW + dt.timedelta(days=7 * i)) for i in range(3)]
    c = build(spark, first)
    event = c.events.first()["event_id"]
    again = build(spark, later, identity=c.identity)
    assert [r.event_id for r in again.events.collect()] == [event]
    assert {r.fate for r in canon.lineage(c.identity, again.identity).collect()} == {"kept"}


RULE = dict(freq="weekly", weekday="MO", week_of_month=None, interval=1, valid_from=None, valid_until=None, except_holidays=[], minutes=1140, duration_minutes=None)


def test_rules_make_series_only_of_dates_that_they_can_make(spark):
    monday = NOW + dt.timedelta(days=(7 - NOW.weekday()) % 7 + 7)
    on, off = claim(1, 1, "Chor", monday)[:-1] + (RULE,), claim(2, 1, "Chor", monday + dt.timedelta(days=2))[:-1] + (RULE,)
    assert build(spark, [on]).identity.where("fingerprint like 'series|%'").count() == 1
    assert build(spark, [off]).identity.where("fingerprint like 'series|%'").count() == 0


def test_rules_out_of_descriptions_join_the_rebuild(spark):
    monday = NOW + dt.timedelta(days=(7 - NOW.weekday()) % 7 + 7)
    row = list(claim(1, 1, "Chor", monday))
    row[14] = "Jeden Montag im Saal"
    open_ = build(spark, [tuple(row)], read_rules=[])
    asked = open_.asked_rules.collect()
    assert len(asked) == 1 and not open_.identity.where("fingerprint like 'series|%'").count()
    known = build(spark, [tuple(row)], read_rules=[(asked[0].content_key, RULE)])
    assert not known.asked_rules.count() and known.identity.where("fingerprint like 'series|%'").count() == 1


def test_twins_move_whole(spark):
    """A venue-less series of four days that shares one of them with the only series of its title joins it with all four."""
    day = lambda i: NOW + dt.timedelta(days=i)
    with_venue = [claim(i, 1, "Yoga", day(i)) for i in (1, 8, 15)]
    without = [claim(20 + i, 2, "Yoga", day(i), venue=None) for i in (15, 23, 24, 25)]
    assert build(spark, with_venue + without).events.count() == 1
    apart = [claim(20 + i, 2, "Yoga", day(i), venue=None) for i in (22, 23, 24, 25)]
    assert build(spark, with_venue + apart).events.count() == 2


def test_estimates_join_the_rebuild(spark):
    c = build(spark, [claim(1, 1, "Jazz im Hof", NOW + dt.timedelta(days=3))], estimates=[])
    asked = c.asked_estimates.collect()
    assert len(asked) == 1 and c.events.first()["age_lo"] is None
    known = build(spark, [claim(1, 1, "Jazz im Hof", NOW + dt.timedelta(days=3))], estimates=[(asked[0].content_key, "estimated", None, 0.9, 0.95, 6, 99, True)])
    assert (known.events.first()["age_lo"], known.events.first()["age_conf"], known.events.first()["price_conf"]) == (6, 0.8, 0.35) and not known.asked_estimates.count()


def test_ledger_refuses_what_was_edited(spark, tmp_path):
    table, book = tables.Versioned(spark, f"file://{tmp_path}/t"), tables.Versioned(spark, f"file://{tmp_path}/l")
    table.swap(spark.createDataFrame([(1,)], "k int"))
    changes = [ledger.Change("one", "SELECT k, k + 1 AS n FROM {table}"), ledger.Change("two", "SELECT *, 'x' AS s FROM {table}")]
    assert ledger.migrate(spark, table, book, changes[:1]) == ["one"]
    assert ledger.migrate(spark, table, book, changes) == ["two"] and ledger.migrate(spark, table, book, changes) == []
    assert [tuple(r) for r in table.read().collect()] == [(1, 2, "x")] and table.number() == 3
    for wrong in ([ledger.Change("one", "SELECT k FROM {table}"), changes[1]], changes[::-1], changes[:1]):
        with pytest.raises(ledger.Edited):
            ledger.migrate(spark, table, book, wrong)
    assert table.number() == 3


def extent(a, b):
    """The best continuous part of b's trigrams against the set of a's, tried one by one."""
    run = lambda t: [f"  {w} "[i : i + 3] for w in re.findall(r"\w+", t.lower()) for i in range(len(w) + 1)]
    a, b = set(run(a)), run(b)
    return max((len(a & set(b[i : j + 1])) / len(a | set(b[i : j + 1])) for i in range(len(b)) for j in range(i, len(b))), default=0.0)


def test_extent_similarity(spark):
    pairs = [("Posthof", "Posthof Linz, Großer Saal"), ("word", "two words"), ("Haus am See", "See Haus"), ("", "x"), ("abc", "xyz"), ("aba aba", "ababa aba abab"), ("Stadt", "Die Stadtwerkstadt")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", similarity.extent_similarity(similarity.word_trigrams(F.col("a")), similarity.word_trigram_run(F.col("b"))).alias("s")).collect()
    assert {(r.a, r.b): round(r.s, 9) for r in got} == {(a, b): round(extent(a, b), 9) for a, b in pairs}


def test_reports(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    feedback, checks = control.reported(t([(1, "o1", "gone", NOW), (2, "o1", "gone", NOW), (3, "o2", "x", NOW), (4, "lost", "x", NOW)], "report_id int, occurrence_id string, reason string, said_at timestamp"), t([("qa", 2, "running"), ("qa", 1, "done")], "kind string, event_id int, status string"), t([("o1", 1), ("o2", 2)], "occurrence_id string, event_id int"))
    assert {r.report_id for r in feedback.collect()} == {1, 2, 3}
    assert [(r.event_id, r.n_reports) for r in checks.collect()] == [(1, 2)]
