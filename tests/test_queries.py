"""Every query against its SQL on the smallest tables, and the contract's other parts."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from evidenceloom.plans import canon, control, queries_canon
from evidenceloom.plans.queries import QUERIES, SQL
from evidenceloom.sources import adapters, scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", ["argmax_field_merge", "canon_events"])
def test_query_equals_sql_where_values_are_unknown(spark, tmp_path, name):
    """Parts without names, items without prices and discounts, suppliers without a balance."""
    con = duckdb.connect()
    odd = {"part": "p_partkey % 7 = 0 THEN NULL ELSE p_name END AS p_name", "lineitem": "l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount", "supplier": "s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal", "orders": "FALSE THEN NULL ELSE o_orderdate END AS o_orderdate"}
    for table, column in odd.items():
        con.execute(f"COPY (SELECT * REPLACE (CASE WHEN {column}) FROM '{SF}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_events_are_summed_up_where_their_claims_lie(spark):
    """Line items are read once and dealt by orders and by parts only: no row for each field, no deal of claims by event."""
    plan = QUERIES["canon_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_partkey#") and plan.count("lineitem.parquet") == 1 and "Generate" not in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "event_id" in x]


def test_events_are_the_same_however_their_claims_lie(spark):
    """By part and source, and apart by event and by source; unknown values, sources, trusts and places, equal weights, claims that repeat."""
    k, text_ = F.col("id"), lambda n, c: F.when(F.col("id") % n != 0, c)
    rows = spark.range(4000).select(
        (k % 90).alias("part_no"), F.concat_ws("|", k % 90, k % 2).alias("event_id"), (k % 1999).cast("string").alias("claim_id"), text_(7, k % 6).alias("source_id"), text_(3, F.lit("a meetup")).alias("source_name"), text_(11, (k % 4) / 4).alias("trust"), text_(13, (k % 3) / 2).alias("confidence"), F.timestamp_seconds(k % 1999).alias("extracted_at"),
        *(text_(n, F.concat(F.lit(f), (k % 1999) % (n + 3))).alias(f) for n, f in enumerate(("title", "description", "venue_name", "address", "category", "organizer"), 2)), text_(5, F.concat(F.lit("https://x.at/"), (k % 1999) % 5)).alias("url"),
        text_(4, (k % 1999) / 8).alias("price_min"), F.lit(None).cast("double").alias("price_max"), text_(9, (k % 1999) / 100).alias("lat"), text_(9, (k % 1999) / 90).alias("lon"), text_(2, F.lit("v")).alias("venue"),
    )
    plain_ = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    apart, where_they_lie = canon.events(rows), canon.events(rows.repartition("part_no"), lie_by="part_no")
    assert apart.dtypes == where_they_lie.dtypes and plain_(apart) == plain_(where_they_lie)


def test_trust_is_rounded_as_in_sql(spark, tmp_path):
    """Balances whose trust is near a half of its last place, on either side."""
    con = duckdb.connect()
    balances = [6378.25, 240.25, 3958.25, 7604.75, 7621.25, 100.0, -999.99]
    con.execute(f"COPY (SELECT 's' AS s_name, i AS s_suppkey, b AS s_acctbal FROM (SELECT unnest({balances})::DOUBLE AS b, unnest(range({len(balances)})) AS i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = con.execute(f"WITH {adapters.SOURCE_SQL} SELECT source_id, trust FROM source ORDER BY 1").fetchall()
    assert [(r.source_id, r.trust) for r in adapters.sources(spark, str(tmp_path)).orderBy("source_id").collect()] == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["event_id", "match_score", "starts_at"]


def test_streaming_equals_batch(spark):
    batch = {tuple(r) for r in QUERIES["event_confidence_noisy_or"](spark, SF).select("event_id", "confidence", "n_sources").collect()}
    assert {tuple(r) for r in QUERIES["streaming_equivalence"](spark, SF).collect()} == batch


@pytest.mark.parametrize("name", ["selector_records", "cascade_records", "rrule_expand", "jsonld_records", "portal_records"])
def test_small_tables_are_dealt_before_pages_are_read(spark, name):
    """A table of a few megabytes is one split: reading its pages was the work of one task."""
    assert "RepartitionByExpression [p_partkey" in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_claims_outside_the_window_go_before_they_are_joined(spark):
    """The window is a condition on the line items, not on the newest claims."""
    plan = canon.load(queries_canon._claims(spark, SF)[0], queries_canon._now())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join") < plan.index("-90")


def test_twins_are_found_without_reading_claims_again_and_again(spark):
    """Claims are in the last step's plan for the join with their groups and for their rules on both sides, not for each comparison of groups."""
    assert QUERIES["canon_twins"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") <= 3


def test_claims_stay_where_they_are_for_names_series_and_shared_prints(spark, monkeypatch):
    """What claims meet there is written and small, so it goes to them; where it is not, they are dealt, to the same result."""
    keep, plans = queries_canon.written, []
    monkeypatch.setattr(queries_canon, "written", lambda df, name: (plans.append(df) if name == "claims-placed" else None, keep(df, name))[1])
    found = QUERIES["canon_series"](spark, SF)
    plans += [found, canon.shared_prints(keep(found.select("group0", F.col("claim_id").alias("fingerprint")), "claims"), "group0")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shown = [df.select("*")._jdf.queryExecution().executedPlan().toString() for df in plans]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the links themselves are made distinct
    assert [p.count("Exchange hashpartitioning(") for p in shown] == [0, 0, 1] and all(p.count("BroadcastExchange") == 1 for p in shown)
    rows = set(found.collect())
    monkeypatch.setattr(scratch, "SMALL_ROWS", -1)
    assert set(QUERIES["canon_series"](spark, SF).collect()) == rows


def test_claims_stay_where_they_are_though_fingerprints_are_many(spark, monkeypatch):
    """Series keys and absorbed groups go to the claims while these are few, however many fingerprints there are."""
    rows = set(QUERIES["canon_series"](spark, SF).collect())
    assert len({r.group0 for r in rows}) > 500 > len({r.group0 for r in rows if r.group0.startswith("series|")}) > 10
    monkeypatch.setattr(scratch, "SMALL_ROWS", 500)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    found = QUERIES["canon_series"](spark, SF)
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shown = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Exchange hashpartitioning(" not in shown
    assert set(found.collect()) == rows


def test_only_ends_in_question_are_dealt(spark, monkeypatch):
    """Claims whose end is settled by themselves meet no instants of their event."""
    kept = []
    monkeypatch.setattr(canon, "written", lambda df, name: (kept.append(name), scratch.written(df, name))[1])
    at = [(f"e{i}", f"1996-06-{d:02} 18:00:00", f"1996-06-{d:02} 20:00:00") for i in range(3) for d in (1, 8)] + [("e0", "1996-06-01 19:00:00", "1996-06-09 20:00:00"), ("e1", "1996-06-08 19:00:00", "1996-06-09 20:00:00")]
    claims = spark.createDataFrame(at, "event_id string, s string, e string").select("event_id", F.col("s").cast("timestamp").alias("starts_at"), F.col("e").cast("timestamp").alias("ends_at"), F.lit("music").alias("category"), F.lit("series|x").alias("group0"))
    found = canon.observed_dates(claims)
    assert kept == ["asking-events"]
    # one end passes the next start of its event and goes, the other long one does not
    assert sorted((r.event_id, r.ends_at is None) for r in found.collect() if r.starts_at.hour == 19) == [("e0", True), ("e1", False)]
    assert found.count() == 8 and found.where("ends_at is null").count() == 1


@pytest.mark.parametrize("name", ["event_source_detail", "price_source_link"])
def test_claims_are_dealt_by_orders_and_parts_only(spark, name, monkeypatch):
    """Line items are shuffled to meet their orders and their parts; sources are few, and an event's rows lie together by its part."""
    plans = []
    monkeypatch.setattr(control, "written", lambda df, _: plans.append(df) or df)
    found = QUERIES[name](spark, SF)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        first = (plans or [found])[0]
        plan = first.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning(") == 4 and plan.count("BroadcastExchange") == 1


def test_schedule_ends_look_at_the_next_start_only(spark):
    """No row for each day of a long end."""
    assert "Generate" not in QUERIES["schedule_ends"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["canon_identity", "canon_lineage"])
def test_versions_are_read_from_written_prints(spark, name):
    """Line items are summed up to prints once, not for each join of the prints."""
    assert "Relation [l_orderkey" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
