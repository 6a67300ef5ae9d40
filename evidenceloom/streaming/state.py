"""Fused claims as keyed state: a batch costs what it brings and the state of the buckets of keys that it touches, however long the log is.

State by event: each source's largest value; the last trusted negative status; and for each trust the last time that something
else was said with it, which is all that decides whether the negative one was taken back; of these times only those after the
negative one that no other of as much trust follows, as no later claim can make the rest count. All of these are maxima, so claims may
come in any order, late or twice, and the state after all batches is that of one batch. Some Arrow batches of claims (131,072 rows) become one such state
for each of their events before the shuffle, so an event with very many claims sends few. Events are kept together by buckets of a
hash, as each call for a group costs milliseconds: events one by one took most of the time in calls. What a task sends to a bucket at once, and
what a bucket keeps, is packed together. The number of buckets, and whether there is a ``retain``, belong to the checkpoint.

With ``retain`` an event that was not heard of for so long (in event time) goes: its bucket's timer gives out a last row, marked as gone, and clears
its state.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NEGATIVE = ("cancelled", "moved", "postponed")
LEAST_TRUST, MOST = 0.5, 0.999999
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FUSED = "event_id string, confidence double, n_sources long, status string, gone boolean"
_NEVER = -(1 << 62)  # the time of what has none
_TOGETHER = 131_072  # claims that a task combines at once
_CODEC = pa.Codec("zstd", compression_level=6)


def _packed(states: dict[str | None, tuple]) -> bytes:
    """Column by column, numbers as their shortest text: half the size of packed objects."""
    values, spoken, negative, heard = zip(*states.values(), strict=True)
    of = lambda maps: [[len(x) for x in maps], [k for x in maps for k in x], [v for x in maps for v in x.values()]]
    plain = json.dumps([list(states), *of(values), *of(spoken), *zip(*(x or (None,) * 4 for x in negative), strict=True), heard], separators=(",", ":")).encode()
    return len(plain).to_bytes(8, "little") + _CODEC.compress(plain, asbytes=True)


def _unpacked(packed: bytes) -> dict[str | None, tuple]:
    events, *columns, at, claim, status, trust, heard = json.loads(_CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True))

    def maps(sizes: list[int], keys: list, values: list) -> list[dict]:
        pairs = zip(keys, values, strict=True)
        return [dict(islice(pairs, n)) for n in sizes]

    negative = (None if x[0] is None else x for x in zip(at, claim, status, trust, strict=True))
    return dict(zip(events, zip(maps(*columns[:3]), maps(*columns[3:]), negative, heard, strict=True), strict=True))


class _State:
    """What is known of an event: values by source, last times of other statuses by trust, the last trusted negative status (time, claim, status, trust), when it was heard of. Times in microseconds."""

    __slots__ = ("heard", "negative", "spoken", "values")

    def __init__(self, parts: tuple | None = None):
        self.values, self.spoken, self.negative, self.heard = parts or ({}, {}, None, _NEVER)

    def parts(self) -> tuple:
        """What can still decide something. A time of no later use: not after the negative status, or followed by one of as much trust."""
        spoken, last = {}, self.negative[0] if self.negative else _NEVER
        for trust in sorted(self.spoken, reverse=True):
            if self.spoken[trust] > last:
                last = spoken[trust] = self.spoken[trust]
        return self.values, spoken, self.negative, self.heard

    def value(self, source: str | None, v: float) -> None:
        if v > self.values.get(source, -math.inf):
            self.values[source] = v

    def other(self, trust: float, at: int) -> None:
        if trust == trust and at > self.spoken.get(trust, _NEVER):  # an unknown trust clears nothing
            self.spoken[trust] = at

    def trusted(self, negative: tuple) -> None:
        if self.negative is None or negative[:2] > self.negative[:2]:
            self.negative = negative

    def add(self, parts: tuple) -> None:
        values, spoken, negative, heard = parts
        for source, v in values.items():
            self.value(source, v)
        for trust, at in spoken.items():
            self.other(trust, at)
        if negative:
            self.trusted(negative)
        self.heard = max(self.heard, heard)

    def row(self, event_id: str | None, gone: bool) -> tuple:
        status = "scheduled"
        if self.negative:
            at, _, bad, trust = self.negative
            # nothing is known to be later than what has no time
            status = "scheduled" if at != _NEVER and any(t >= trust and a > at for t, a in self.spoken.items()) else bad
        confidence = 1 - math.exp(math.fsum(math.log1p(-v) for v in self.values.values()))
        return event_id, confidence, len(self.values), status, gone


def combined(claims: DataFrame, buckets: int, timed: bool) -> DataFrame:
    """The states that a task's claims give, some batches at a time: a row for each bucket, or, if timed, for each event with the newest of its times. Without state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str | None, _State] = {}
        newest: dict[str | None, pd.Timestamp] = {}
        places: dict[str | None, int] = {}
        n = 0

        def rows() -> pd.DataFrame:
            if timed:
                return pd.DataFrame({"bucket": list(places.values()), "at": pd.Series(list(newest.values()), dtype="datetime64[ns]"), "said": [_packed({e: x.parts()}) for e, x in found.items()]})
            of: dict[int, dict] = {}
            for event, x in found.items():
                of.setdefault(places[event], {})[event] = x.parts()
            return pd.DataFrame({"bucket": list(of), "said": [_packed(x) for x in of.values()]})

        for f in frames:
            columns = (f[c].tolist() for c in ("bucket", "event_id", "source_id", "trust", "v", "us", "claim_id", "status", "negative"))
            for i, (bucket, event, source, trust, v, us, claim, status, negative) in enumerate(zip(*columns, strict=True)):
                state = found.get(event)
                if state is None:
                    state = found[event] = _State()
                    places[event] = bucket
                state.value(source, v)
                if not negative:
                    state.other(trust, us)
                elif trust > LEAST_TRUST:
                    state.trusted((us, claim, status, trust))
                if timed and us >= state.heard:
                    state.heard, newest[event] = us, f["at"].iat[i]
            n += len(f)
            if n >= _TOGETHER:
                yield rows()
                n = 0
                found.clear(), newest.clear(), places.clear()
        if found:
            yield rows()

    c = claims.selectExpr("cast(event_id as string) event_id", "cast(source_id as string) source_id", "cast(trust as double) trust", "cast(confidence as double) confidence", "cast(extracted_at as timestamp) at", "coalesce(cast(claim_id as string), '') claim_id", "cast(status as string) status")
    negative = F.coalesce(F.col("status").isin(*NEGATIVE), F.lit(False))
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int").alias("bucket")
    at = ["at"] if timed else []
    rows = c.select(bucket, "event_id", "source_id", "trust", F.least(F.col("trust") * F.col("confidence"), F.lit(MOST)).alias("v"), *at, F.coalesce(F.unix_micros("at"), F.lit(_NEVER)).alias("us"), "claim_id", "status", negative.alias("negative"))
    return rows.mapInPandas(run, f"bucket int, {'at timestamp, ' if timed else ''}said binary")


def fused(stream: DataFrame, retain: dt.timedelta | None = None, late: str = "7 days", buckets: int = 4096) -> DataFrame:
    """Each batch's touched events as they are after it. Columns of the stream: event_id, source_id, claim_id, trust, confidence, extracted_at, status."""
    retain_ms = None if retain is None else int(retain.total_seconds() * 1000)
    columns = [x.split()[0] for x in FUSED.split(", ")]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[str | None, tuple] = _unpacked(state.get[0]) if state.exists else {}
        touched: dict[str | None, _State] = {}
        for f in () if state.hasTimedOut else frames:
            for said in f["said"].tolist():
                for event, parts in _unpacked(said).items():
                    x = touched.get(event)
                    if x is None:
                        x = touched[event] = _State(known.get(event))
                    x.add(parts)
        known |= {event: x.parts() for event, x in touched.items()}
        rows = [x.row(event, False) for event, x in touched.items()]
        if retain_ms is not None:
            last = state.getCurrentWatermarkMs() - retain_ms
            gone = [event for event, parts in known.items() if parts[3] // 1000 <= last]
            rows += [_State(known.pop(event)).row(event, True) for event in gone]
        if known:
            state.update((_packed(known),))
        elif state.exists:
            state.remove()
        if known and retain_ms is not None:
            state.setTimeoutTimestamp(min(parts[3] for parts in known.values()) // 1000 + retain_ms)
        yield pd.DataFrame(rows, columns=columns)

    rows = combined(stream, buckets, retain is not None)
    rows = rows if retain is None else rows.withWatermark("at", late)
    timeout = GroupStateTimeout.NoTimeout if retain is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("bucket").applyInPandasWithState(fold, FUSED, "known binary", "update", timeout)


def keep(updates: DataFrame, out_path: str, checkpoint: str):
    """Writes each batch's updates as a version of their own, until what is there is consumed. A batch that runs again writes the same folder again."""
    spark = updates.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    with state_store(spark):
        return updates.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class state_store:  # noqa: N801
    """Queries that start meanwhile keep their state in RocksDB, as maps and timers need, and of it what a restart needs: each batch writes its buckets anew, and the versions before go."""

    wanted = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.streaming.minBatchesToRetain": "2"}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
