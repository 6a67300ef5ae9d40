"""Streams against their batch results."""

import datetime as dt
import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from evidenceloom.operators import evidence
from evidenceloom.plans import control
from evidenceloom.sources import changelog, tables
from evidenceloom.streaming import claims as S
from evidenceloom.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture
def log(spark, tmp_path):
    """The event log as files in order of time, one for each micro-batch."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [r[0] for r in events.select(F.expr("percentile_approx(ts, array(0.33, 0.66))").alias("c")).select(F.explode("c")).collect()]
    parts = [events.where(F.col("ts") <= cuts[0]), events.where((F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1])), events.where(F.col("ts") > cuts[1])]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return events, f"{tmp_path}/in"


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_log_is_appended_once(spark, log, tmp_path):
    events, path = log
    for _ in range(2):  # a restart finds nothing new
        S.log_claims(S.source(spark, path, events.schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_windows(spark, log):
    events, path = log
    got = drained(S.windowed_counts(S.source(spark, path, events.schema), late="40 days"), "windows", "complete")
    want = events.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.start, r.event_type, r.n) for r in want.collect()}


def test_first_sightings(spark, log):
    events, path = log
    got = drained(S.first_seen(S.source(spark, path, events.schema), "user_id", late="60 days"), "first", "append")
    assert sorted(r.user_id for r in got.collect()) == sorted(r.user_id for r in events.select("user_id").distinct().collect())


def test_running_average_equals_batch(spark, log):
    events, path = log
    stream = S.running_average(S.source(spark, path, events.schema), "user_id", "value", "ts", 0.3)
    got = {r.user_id: (r.average, r.n) for r in drained(stream, "averages", "update").collect()}
    want = {r.user_id: (r.average, r.n) for r in evidence.moving_average(events, ["user_id"], [F.col("ts").desc()], "value", 0.3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


def test_late_claims_change_what_they_touch(spark, tmp_path):
    """Versions follow the batches; a reader that knows one goes on from there."""
    rows = [("e1", "s1", 0.5, 0.5), ("e2", "s1", 0.5, 0.4)], [("e1", "s2", 0.8, 0.5)], [("e3", "s1", 0.1, 0.1)]
    schema = "event_id string, source_id string, trust double, confidence double"
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        S.recompute_touched(S.source(spark, path, spark.read.parquet(path).schema, 1), f"file://{tmp_path}/log", "event_id", S.confidence, out, f"{tmp_path}/cp", buckets=4).awaitTermination()
    seen = [(r.version, r.event_id, round(r.confidence, 6), r.n_sources) for r in S.changes(spark, out, "event_id").collect()]
    assert seen == [(0, "e1", 0.25, 1), (0, "e2", 0.2, 1), (1, "e1", 0.55, 2), (2, "e3", 0.01, 1)]
    assert [r.event_id for r in S.changes(spark, out, "event_id", after=1).collect()] == ["e3"]
    S.compact(spark, out, "event_id", f"file://{tmp_path}/latest")
    assert {(r.event_id, r.n_sources) for r in spark.read.parquet(f"file://{tmp_path}/latest").collect()} == {("e1", 2), ("e2", 1), ("e3", 1)}


# ---- fused claims as state

CLAIM = "event_id string, source_id string, claim_id string, trust double, confidence double, extracted_at timestamp, status string"


def some_claims(n):
    rng = random.Random(n)
    at = lambda: dt.datetime(2026, 3, 1) + dt.timedelta(minutes=rng.randrange(5000))
    return [(f"e{rng.choice([0, 0, 0, *range(12)])}", f"s{rng.randrange(6)}", f"c{i}", rng.choice([0.4, 0.6, 0.8]), rng.choice([0.3, 0.9, 1.0]), at(), rng.choice(["scheduled", "scheduled", None, "cancelled", "moved"])) for i in range(n)]


def test_state_equals_batch_whatever_the_order(spark, tmp_path):
    """Ten batches of claims out of order, with repeats and late ones, give what all of them at once give."""
    rows = some_claims(400)
    random.Random(1).shuffle(rows)
    path = f"file://{tmp_path}/in"
    for i in range(10):
        spark.createDataFrame(rows[40 * i : 40 * i + 40] + rows[max(0, 40 * i - 5) : 40 * i], CLAIM).coalesce(1).write.mode("append").parquet(path)
    stream = S.source(spark, path, spark.read.parquet(path).schema, 1)
    query = state.keep(state.fused(stream), f"file://{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    got = {r.event_id: (round(r.confidence, 9), r.n_sources, r.status) for r in S.latest(spark, f"file://{tmp_path}/out", "event_id").collect()}
    all_ = spark.createDataFrame(rows, CLAIM)
    confidence = {r.event_id: (round(r.confidence, 9), r.n_sources) for r in S.confidence(all_).collect()}
    status = {r.event_id: r.status for r in evidence.merge_status(all_, ["event_id"]).collect()}
    assert got == {k: (*confidence[k], status[k]) for k in confidence}
    # a batch reads the rows that it brings, not those before it
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [40] + [45] * 9
    # a restart goes on from the state
    spark.createDataFrame([("e0", "new", "x", 0.9, 0.9, dt.datetime(2026, 3, 1), None)], CLAIM).coalesce(1).write.mode("append").parquet(path)
    state.keep(state.fused(S.source(spark, path, spark.read.parquet(path).schema, 1)), f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert S.latest(spark, f"file://{tmp_path}/out", "event_id").where("event_id = 'e0'").first()["n_sources"] == got["e0"][1] + 1


def test_state_asks_once_for_a_bucket_and_not_for_each_event(spark, tmp_path):
    """20,000 events in two batches: calls for single events took minutes. Unknown values, trusts, times and sources give what all claims at once give."""
    k = F.col("id")
    odd = lambda n, c: F.when(k % n != 0, c)
    rows = spark.range(60000).select((k % 20000).cast("string").alias("event_id"), odd(11, (k % 7).cast("string")).alias("source_id"), k.cast("string").alias("claim_id"), odd(13, (k % 5) / 5).alias("trust"), odd(17, (k % 9) / 9).alias("confidence"), odd(19, F.timestamp_seconds(k * 37 % 60000)).alias("extracted_at"), F.when(k % 4 == 0, "moved").when(k % 4 != 1, "scheduled").alias("status"))
    path = f"file://{tmp_path}/in"
    rows.repartition(2).write.parquet(path)
    began = time.monotonic()
    state.keep(state.fused(S.source(spark, path, rows.schema, 1), buckets=64), f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert time.monotonic() - began < 60
    want = S.confidence(rows).join(evidence.merge_status(rows, ["event_id"]), "event_id")
    plain = lambda df: {r.event_id: (round(r.confidence, 9), r.n_sources, r.status) for r in df.collect()}
    assert plain(S.latest(spark, f"file://{tmp_path}/out", "event_id")) == plain(want)


def test_state_is_packed_and_keeps_what_can_decide(spark, tmp_path):
    """A message and the state of a bucket of events take few bytes, whatever is unknown in them comes back, and times that decide nothing are not kept."""
    odd = {None: ({None: 0.1 + 0.2, "s|,\n\"1": 0.0}, {0.7: -5, 0.3: 1 << 60}, (state._NEVER, "", "moved", math.inf), state._NEVER), "e": ({}, {}, None, 7), "": ({"s": -0.5}, {math.inf: 3}, (3, "c", "moved", 0.8), 1)}
    assert state._unpacked(state._packed(odd)) == odd
    x = state._State(({}, {0.9: 50, 0.8: 70, 0.7: 60, 0.6: 10, 0.5: 90}, (50, "c", "moved", 0.7), 90))
    assert x.parts()[1] == {0.8: 70, 0.5: 90}
    k = F.col("id")
    rows = spark.range(60000).select(F.concat_ws("|", k * 7 % 15000, k % 2 + 1995).alias("event_id"), (k % 1000).cast("string").alias("source_id"), F.concat_ws("-", k * 100, k % 15000, k * 31 % 9973).alias("claim_id"), (k % 1000 / 1000).alias("trust"), (k % 11 / 11).alias("confidence"), F.timestamp_seconds(k % 2500 * 86400).alias("extracted_at"), F.when(k % 4 == 0, "moved").otherwise("scheduled").alias("status"))
    said = state.combined(rows.coalesce(1), 64, False).select(F.count("*"), F.sum(F.length("said"))).first()
    assert said[0] == 64 and said[1] < 60000 * 40


def test_a_status_without_a_time_holds(spark, tmp_path):
    """Nothing is known to be later than it."""
    rows = spark.createDataFrame([("e", "s1", "c1", 0.8, 0.5, None, "moved"), ("e", "s2", "c2", 0.9, 0.5, dt.datetime(2026, 3, 1), "scheduled")], CLAIM)
    rows.write.parquet(f"file://{tmp_path}/in")
    state.keep(state.fused(S.source(spark, f"file://{tmp_path}/in", rows.schema), buckets=4), f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert evidence.merge_status(rows, ["event_id"]).first()["status"] == "moved"
    assert [r.status for r in S.latest(spark, f"file://{tmp_path}/out", "event_id").collect()] == ["moved"]


def test_an_events_claims_come_in_four_batches(spark, monkeypatch):
    """The files of the log are dealt by order, not by text or by event, and most events of several claims come again."""
    from evidenceloom.plans.queries import QUERIES

    kept, keep = [], state.keep
    monkeypatch.setattr(state, "keep", lambda updates, out, checkpoint: kept.append(out) or keep(updates, out, checkpoint))
    n = QUERIES["streaming_state"](spark, SF).count()
    versions = spark.read.parquet(kept[0])
    assert versions.select("version").distinct().count() == 4 and versions.count() > 1.5 * n


def test_events_that_nobody_speaks_of_go(spark, tmp_path):
    path, day = f"file://{tmp_path}/in", dt.datetime(2026, 3, 1)
    for i, (event, days) in enumerate([("old", 0), ("old", 5), ("other", 40), ("other", 80), ("other", 81)]):
        spark.createDataFrame([(event, "s1", f"c{i}", 0.8, 0.5, day + dt.timedelta(days=days), None)], CLAIM).coalesce(1).write.mode("append").parquet(path)
        stream = S.source(spark, path, spark.read.parquet(path).schema, 1)
        state.keep(state.fused(stream, retain=dt.timedelta(days=30), late="1 day"), f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").where("gone").select("event_id", "n_sources").collect()
    assert [tuple(r) for r in rows] == [("old", 1), ("other", 1)] or [tuple(r) for r in rows] == [("old", 1)]


# ---- versions and changes


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, name string, tags array<string>")


def test_changes_tell_the_newest_version(spark, tmp_path):
    table, log = tables.Versioned(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}/log"
    versions = [people(spark, (1, "a", ["x"]), (2, None, []), (None, "n", None)), people(spark, (1, "a", ["x"]), (2, "", []), (3, "c", None)), people(spark, (3, "c", ["y"]), (None, "n", None)), people(spark, (3, "c", ["y"]), (None, "n", None))]
    for v in versions:
        changelog.publish(table, table.swap(v), log, ["k"])
    found = changelog.changes(spark, log, versions[0].schema)
    said = sorted(((r.version, r.op, r.k) for r in found.collect()), key=repr)
    assert said == sorted([(1, "insert", 1), (1, "insert", 2), (1, "insert", None), (2, "update", 2), (2, "insert", 3), (2, "delete", None), (3, "delete", 1), (3, "delete", 2), (3, "update", 3), (3, "insert", None)], key=repr)
    key = lambda df: sorted(map(repr, df.select("k", "name", "tags").collect()))
    assert key(changelog.replay(found, ["k"])) == key(versions[-1])
    for n in range(1, 5):
        assert key(changelog.replay(found.where(F.col("version") <= n), ["k"])) == key(versions[n - 1])
    assert {r.version for r in changelog.changes(spark, log, versions[0].schema, after=2).collect()} == {3}
    # a stream that follows the log sees each change once, also over restarts
    for _ in range(2):
        changelog.follow(spark, log, versions[0].schema, 1).writeStream.format("parquet").option("path", f"{tmp_path}/copy").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    copy = spark.read.parquet(f"{tmp_path}/copy")
    assert copy.count() == found.count() and key(changelog.replay(copy, ["k"])) == key(versions[-1])
    before = [r.version for r in found.collect()]
    changelog.publish(table, 2, log, ["k"])  # again: nothing changes
    assert sorted(r.version for r in changelog.changes(spark, log, versions[0].schema).collect()) == sorted(before)


def test_writers_at_once_lose_no_version(spark, tmp_path):
    """Each of several threads adds its rows to what is there; all of them are there in the end."""
    table = tables.Versioned(spark, f"file://{tmp_path}/t")
    table.swap(people(spark, (0, "start", None)))
    failed = []

    def add(worker):
        try:
            for i in range(3):
                table.update(lambda now, i=i: now.unionByName(people(spark, (10 * worker + i, "w", None))), tries=50)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    workers = [threading.Thread(target=add, args=(w,)) for w in (1, 2, 3)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert not failed and table.number() == 10
    assert sorted(r.k for r in table.read().collect()) == [0, 10, 11, 12, 20, 21, 22, 30, 31, 32]
    with pytest.raises(tables.Conflict):
        table.swap(people(spark, (99, "late", None)), after=4)
    assert {r.k for r in table.read(1).collect()} == {0}
    table.vacuum(keep=2)
    assert len(list((tmp_path / "t").glob("v-*"))) == 2 and table.read().count() == 10


def test_each_job_is_one_workers(spark, tmp_path):
    at = dt.datetime(2026, 3, 1)
    jobs = spark.createDataFrame([(i, "pending" if i != 3 else "failed", at + dt.timedelta(minutes=i), None, None, 0) for i in range(9)], "job_id int, status string, run_after timestamp, worker string, started_at timestamp, attempts int")
    table = tables.Versioned(spark, f"file://{tmp_path}/jobs")
    table.swap(jobs)
    got = {}

    def work(name):
        got[name] = [[r.job_id for r in control.claim_jobs(table, name, F.lit(at + dt.timedelta(hours=1)), 2).collect()] for _ in range(2)]

    workers = [threading.Thread(target=work, args=(n,)) for n in ("a", "b")]
    [w.start() for w in workers]
    [w.join() for w in workers]
    took = [j for lists in got.values() for x in lists for j in x]
    assert len(took) == len(set(took)) == 8 and 3 not in took
    assert {(r.status, r.attempts) for r in table.read().where("job_id != 3").collect()} == {("running", 1)}
    assert control.claim_jobs(table, "c", F.lit(at + dt.timedelta(hours=1)), 2).count() == 0


def test_claims_are_streamed_from_more_than_four_files(spark, monkeypatch):
    """A file is one task's: four took a quarter of all claims each."""
    from evidenceloom.plans.queries import QUERIES

    read, source = [], S.source
    monkeypatch.setattr(S, "source", lambda spark, path, *more: read.append(path) or source(spark, path, *more))
    QUERIES["streaming_equivalence"](spark, SF)
    assert len(spark.read.parquet(read[0]).inputFiles()) > 16
