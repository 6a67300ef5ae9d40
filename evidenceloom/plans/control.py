"""The control plane as queries: what is due, broken, dormant, worth its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenceloom.functions.timeutil import local_day, local_trunc
from evidenceloom.operators.evidence import uniqueness
from evidenceloom.plans.present import deep_url
from evidenceloom.sources.scratch import small, written
from evidenceloom.sources.tables import Versioned

BLOCKED = r"(?i)(403|429|captcha|forbidden|blocked|access denied)"


def last_n(log: DataFrame, key: str, order: list[Column], n: int, bad: Column) -> DataFrame:
    """Whether each key's last n rows are all bad (and there are n)."""
    w = Window.partitionBy(key).orderBy(*order)
    last = log.withColumns({"_n": F.row_number().over(w), "_bad": bad}).where(F.col("_n") <= n)
    return last.groupBy(key).agg((F.every("_bad") & (F.count("*") == n)).alias("streak"))


def sustained(log: DataFrame, key: str, order: list[Column], flag: Column) -> DataFrame:
    """Longest run of consecutive flagged rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = log.withColumn("_f", flag).withColumns({"_i": F.sum((~F.col("_f")).cast("int")).over(w)})
    runs = islands.where("_f").groupBy(key, "_i").agg(F.count("*").alias("n"))
    return log.select(key).distinct().join(runs.groupBy(key).agg(F.max("n").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("longest"))


def priority(claims: DataFrame, spend: DataFrame, source: str = "source_id", event: str = "event_id") -> DataFrame:
    """Yield times uniqueness over cost of each source: what to crawl first."""
    worth = uniqueness(claims, source, event)
    return worth.join(spend, source, "left").select(source, "uniqueness", "n_events", (F.coalesce("yield_ema", F.lit(0.0)) * F.col("uniqueness") / F.greatest(F.coalesce("cost_ema", F.lit(0.0)), F.lit(0.001))).alias("priority"))


def due(sources: DataFrame, soon: DataFrame, queued: DataFrame, now: Column) -> DataFrame:
    """Sources to crawl now: active ones whose interval (a day at most if one of their events is within 72 hours) has passed, dormant ones after 30 days, never crawled ones; none that is queued."""
    near = soon.select("source_id").distinct().withColumn("near", F.lit(True))
    s = sources.join(near, "source_id", "left").join(queued.select("source_id").distinct(), "source_id", "left_anti")
    interval = F.when(F.col("near"), F.least(F.col("interval_s"), F.lit(86400))).otherwise(F.col("interval_s"))
    wait = F.when(F.col("status") == "dormant", 30 * 86400).otherwise(interval)
    since = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_crawled").cast("timestamp"))
    return s.where(F.col("status").isin("active", "dormant") & (F.col("last_crawled").isNull() | (since >= wait)))


def transitions(sources: DataFrame, log: DataFrame, order: list[Column], error: Column) -> DataFrame:
    """source_id and new_status: dormant at a yield below 0.05 after five crawls, degraded after five errors in a row."""
    counts = log.groupBy("source_id").agg(F.count("*").alias("n_crawls"))
    broken = last_n(log, "source_id", order, 5, error)
    s = sources.join(counts, "source_id", "left").join(broken, "source_id", "left")
    new = F.when(F.coalesce("streak", F.lit(False)), "degraded").when((F.col("yield_ema") < 0.05) & (F.coalesce("n_crawls", F.lit(0)) >= 5), "dormant")
    return s.where("status = 'active'").select("source_id", new.alias("new_status")).where("new_status is not null")


def spend_to_date(spend: DataFrame, now: Column, at: str = "spent_at", amount: str = "amount") -> DataFrame:
    """Spend since the local day and month began."""
    since = lambda unit: F.coalesce(F.sum(F.when((F.col(at) >= local_trunc(unit, now)) & (F.col(at) <= now), F.col(amount))), F.lit(0.0))
    return spend.agg(since("day").alias("today"), since("month").alias("month"))


def within_budget(spent: DataFrame, daily_cap: float, monthly_cap: float) -> DataFrame:
    return spent.withColumn("allowed", (F.col("today") < daily_cap) & (F.col("month") < monthly_cap))


def anomalies(days: DataFrame, count: str = "n", day: str = "day", factor: float = 0.5) -> DataFrame:
    """Days with less than a share (half) of their weekday's median, where that is four at least."""
    median = days.groupBy(F.weekday(day).alias("weekday")).agg(F.median(count).alias("median"))
    return days.withColumn("weekday", F.weekday(day)).join(F.broadcast(median), "weekday").where((F.col("median") >= 4) & (F.col(count) < factor * F.col("median")))


def dead_man(log: DataFrame, ok: Column, at: str, now: DataFrame, hours: int = 48) -> DataFrame:
    """Last success, and whether it is too long before now (a table of one row)."""
    last = log.where(ok).agg(F.max(at).alias("last_ok")).join(F.broadcast(now))
    silent = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("last_ok").cast("timestamp")) > hours * 3600
    return last.select("last_ok", F.coalesce(silent, F.lit(True)).alias("dead"))


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *(F.try_divide(F.count(f), F.count("*")).alias(f"has_{f}") for f in fields))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of a hash of their key: the same ones each time."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def trust_feedback(sources: DataFrame, checks: DataFrame, alpha: float = 0.1) -> DataFrame:
    """trust moved towards the share of checks that found the event; drift where three or more did not."""
    seen = checks.groupBy("source_id").agg(F.avg(F.col("found").cast("double")).alias("accuracy"), F.count_if(~F.col("found")).alias("missing"))
    return sources.join(seen, "source_id", "left").select("source_id", F.when(F.col("accuracy").isNull(), F.col("trust")).otherwise((1 - alpha) * F.col("trust") + alpha * F.col("accuracy")).alias("trust"), (F.coalesce("missing", F.lit(0)) >= 3).alias("drift"))


def horizon(rows: DataFrame, key: list[str], starts: str, now: Column, q: float | None = None) -> DataFrame:
    """Days ahead that a source's dates reach: the furthest, or the lower q-quantile, to one decimal; only future dates count."""
    days = (F.unix_seconds(F.col(starts).cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 86400.0
    ahead = rows.select(*key, days.alias("d")).where("d > 0")
    if q is None:
        return ahead.groupBy(*key).agg(F.round(F.max("d"), 1).alias("horizon_days"))
    w = Window.partitionBy(*key)
    ranked = ahead.withColumns({"i": F.row_number().over(w.orderBy("d")) - 1, "n": F.count("*").over(w)})
    return ranked.where(F.col("i") == F.floor(q * (F.col("n") - 1))).select(*key, F.round("d", 1).alias("horizon_days"))


def onboarding_rings(expected: Column) -> Column:
    """Money, turns and seconds that a session may take, by the events it expects."""
    money = F.least(F.lit(2.5), F.greatest(F.lit(0.6), 0.03 * expected))
    share = money / 0.6
    return F.struct(money.alias("cap_eur"), F.least(F.lit(60), F.floor(25 * share)).cast("int").alias("turns"), F.least(F.lit(3600), F.floor(1500 * share)).cast("int").alias("seconds"))


def auc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks: no pairs. Scores are dealt out by ranges; a range needs only the negatives of the ranges below."""
    by = scores.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    ranged = written(by.repartitionByRange("s").select("s", "p", "q", F.spark_partition_id().alias("part")), "auc-ranges")
    totals = ranged.groupBy("part").agg(F.sum("q").alias("t"))
    # a row for each range
    offsets = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranged.withColumn("below", below).join(F.broadcast(offsets), "part")
    return won.agg((F.sum(F.col("p") * (F.col("before") + F.col("below") + F.col("q") / 2)) / (F.sum("p").cast("double") * F.sum("q"))).alias("auc"))


def precision(pairs: DataFrame, same: Column, merged: Column) -> DataFrame:
    """Share of the merged pairs that people call the same, and of the same ones that were merged."""
    hit = F.count_if(same & merged)
    return pairs.agg(F.count_if(merged).alias("merged"), F.try_divide(hit, F.count_if(merged)).alias("precision"), F.try_divide(hit, F.count_if(same)).alias("recall"))


def fit_logistic(pairs: DataFrame, cosine: str, target: str) -> DataFrame:
    """Centre and temperature of the logistic with the smallest squared error on a grid: a pair is a row for each centre, with a sum for each temperature."""
    tried = pairs.select(F.col(cosine).alias("c"), F.col(target).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")).withColumn("center", 0.2 + 0.02 * F.col("i"))
    steps = {f"e{j}": 0.02 * F.lit(j) for j in range(1, 16)}
    errors = tried.groupBy("center").agg(*(F.avg(F.pow(1 / (1 + F.exp((F.col("center") - F.col("c")) / temperature)) - F.col("t"), 2)).alias(name) for name, temperature in steps.items()))
    grid = errors.select("center", F.explode(F.array(*(F.struct(temperature.alias("temperature"), F.col(name).alias("mse")) for name, temperature in steps.items()))).alias("g")).select("center", "g.*")
    return grid.orderBy("mse", "center", "temperature").limit(1)


def local_counts(rows: DataFrame, at: str) -> DataFrame:
    return rows.groupBy(local_day(F.col(at)).alias("day")).agg(F.count("*").alias("n"))


def stale(jobs: DataFrame, now: Column, hours: int = 4) -> DataFrame:
    """Jobs that have been running for too long: to be queued again."""
    return jobs.where((F.col("status") == "running") & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > hours * 3600))


def ready(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that may run, oldest first within their kind."""
    return jobs.where((F.col("status") == "pending") & (F.col("run_after") <= now)).orderBy("run_after", "job_id")


def claimed(jobs: DataFrame, worker: str, now: Column, limit: int = 1) -> DataFrame:
    """The job table after a worker took the first ready jobs: running, with one more attempt."""
    mine = ready(jobs, now).limit(limit).select("job_id", F.lit(True).alias("_mine"))
    took = jobs.join(mine, "job_id", "left")
    new = {"status": F.lit("running"), "worker": F.lit(worker), "started_at": now, "attempts": F.col("attempts") + 1}
    return took.withColumns({n: F.when(F.col("_mine"), c.cast(jobs.schema[n].dataType)).otherwise(F.col(n)) for n, c in new.items()}).select(*jobs.columns)


def claim_jobs(table: Versioned, worker: str, now: Column, limit: int = 1) -> DataFrame:
    """Takes jobs from a versioned job table, of which other workers take some at the same time: each job is one worker's, as each version follows the one that it was made from."""
    number = table.update(lambda jobs: claimed(jobs, worker, now, limit))
    before = table.read(number - 1).select("job_id", F.col("attempts").alias("_n"))
    return table.read(number).where(F.col("worker") == worker).join(before, "job_id").where("attempts > _n").drop("_n")


def reported(reports: DataFrame, jobs: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What readers say is wrong: feedback rows (of occurrences that there are, others are dropped), and a check of each event that was reported and has none waiting, which goes to the front.

    reports: report_id, occurrence_id, reason, said_at. jobs: kind, event_id, status. occurrences: occurrence_id, event_id.
    """
    feedback = reports.join(occurrences.select("occurrence_id", "event_id"), "occurrence_id")
    waiting = jobs.where((F.col("kind") == "qa") & F.col("status").isin("pending", "running")).select("event_id").distinct()
    checks = feedback.groupBy("event_id").agg(F.min("said_at").alias("run_after"), F.count("*").alias("n_reports")).join(waiting, "event_id", "left_anti")
    return feedback.select("report_id", "occurrence_id", "event_id", "reason", "said_at"), checks.select(F.lit("qa").alias("kind"), "event_id", "run_after", "n_reports")


def enqueue_once(wanted: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted jobs of which none is pending, each once."""
    return wanted.dropDuplicates(keys).join(pending.select(*keys), keys, "left_anti")


def rotated(terms: DataFrame, areas: DataFrame, start: int, n: int) -> DataFrame:
    """n pairs of a term and an area from a place in the matrix of all pairs, which goes on at its beginning; only the n pairs are made.

    terms and areas are short configured lists, numbered from 0 (term_no, area_no).
    """
    sizes = terms.agg(F.count("*").alias("t")).join(areas.agg(F.count("*").alias("a")))
    places = sizes.select("t", "a", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("t") * F.col("a")) - 1)).alias("i")).withColumn("k", F.pmod(F.col("i") + start, F.col("t") * F.col("a")))
    numbered = places.select("i", F.floor(F.col("k") / F.col("a")).cast("long").alias("term_no"), F.pmod("k", "a").cast("long").alias("area_no"))
    return numbered.join(terms, "term_no").join(areas, "area_no")


def hydration(events: DataFrame, tried: DataFrame, now: Column, signal: str, days: int = 30, limit: int = 40) -> DataFrame:
    """Events with a deep link but without a description or price, not tried within a month: those with neither first, then titles with a signal, then the earliest."""
    recent = tried.where(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("tried_at").cast("timestamp")) < days * 86400).select("event_id")
    open_ = events.where(F.col("url").isNotNull() & (F.col("description").isNull() | F.col("price_min").isNull())).join(recent, "event_id", "left_anti")
    both = F.col("description").isNull() & F.col("price_min").isNull()
    return open_.orderBy(both.desc(), F.col("title").rlike(signal).desc(), "starts_at", "event_id").limit(limit)


def newest_link(claims: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    """A claim for each event and source, those with a web link first, then the newest; and when the source was last seen anywhere.

    dealt: columns that follow from the event and by which claims lie together already; then claims are not dealt again.
    What is kept is written with the pair's last sighting, so sources are summed up over pairs and no claim is joined twice.
    """
    pair = Window.partitionBy(*dealt, "event_id", "source_id")
    one = pair.orderBy(F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)).desc(), F.col("extracted_at").desc(), "claim_id")
    kept = written(claims.withColumns({"_n": F.row_number().over(one), "_seen": F.max("extracted_at").over(pair)}).where("_n = 1").drop("_n", *dealt), "newest-links")
    seen = written(kept.groupBy("source_id").agg(F.max("_seen").alias("source_seen")), "sources-seen")
    return kept.drop("_seen").join(small(seen), "source_id")


def retries(sources: DataFrame, jobs: DataFrame, now: Column, days: int = 7, most: int = 4, per_tick: int = 5) -> DataFrame:
    """What becomes of broken sources: source_id, action (retry, or dormant after the last try) and attempt; the most productive few at a time.

    None whose repair is queued or running, or was tried within the last days. jobs: source_id, kind, status, ended_at.
    """
    c = F.col
    open_ = jobs.where(c("kind").isin("agent_extract", "onboard") & c("status").isin("pending", "running")).select("source_id")
    lately = jobs.where((c("kind") == "agent_extract") & c("status").isin("done", "failed") & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(c("ended_at").cast("timestamp")) < days * 86400)).select("source_id")
    left = sources.where("status = 'degraded'").join(open_.union(lately).distinct(), "source_id", "left_anti")
    tries = F.coalesce("attempts", F.lit(0))
    picked = left.orderBy(c("yield_ema").desc_nulls_last(), "source_id").limit(per_tick)
    return picked.select("source_id", F.when(tries >= most, "dormant").otherwise("retry").alias("action"), F.when(tries < most, tries + 1).alias("attempt"))


def capped_feeds(sources: DataFrame, least_yield: float = 10, horizon_days: float = 10) -> DataFrame:
    """Productive active sources that never reach far ahead, once each: feeds get a companion website, websites are looked at again."""
    c = F.col
    capped = sources.where((c("status") == "active") & (c("yield_ema") >= least_yield) & (c("horizon_days") <= horizon_days) & ~F.coalesce("escalated", F.lit(False)))
    feed = c("kind").isin("api", "ics", "rss")
    site = F.concat(F.lit("https://"), F.try_parse_url("url", F.lit("HOST")), F.lit("/"))
    found = capped.select("source_id", F.when(feed, "companion").otherwise("onboard").alias("action"), F.when(feed, site).alias("site_url"))
    known = sources.select(F.col("url").alias("site_url")).distinct()
    return found.join(known, "site_url", "left_anti").unionByName(found.where("site_url is null")).distinct().select("source_id", "action", "site_url")


def placeless_sources(sources: DataFrame, events: DataFrame, least: int = 5) -> DataFrame:
    """Active sources, once each, of whose coming events most (and five at least) have neither a place nor a page of their own.

    events: source_id, event_id, venue_id, lat, url, starting in the future.
    """
    c = F.col
    homes = sources.select(c("url").alias("url"), F.lit(True).alias("home")).where("url is not null").distinct()
    own = events.select("source_id", "event_id", "venue_id", "lat", "url").distinct().join(homes, "url", "left")
    lost = c("venue_id").isNull() & c("lat").isNull() & (~deep_url(c("url")) | c("home").isNotNull())
    share = own.groupBy("source_id").agg(F.count_if(lost).alias("lost"), F.count("*").alias("n"))
    few = share.where(c("lost") >= F.greatest(F.lit(least), 0.5 * c("n")))
    return sources.where((c("status") == "active") & ~F.coalesce("venue_escalated", F.lit(False))).join(few, "source_id").select("source_id", "lost", "n")


def not_yet(jobs: DataFrame, unit: str, now: Column, at: str = "created_at") -> DataFrame:
    """Kinds of jobs that were not queued since the local day or week began: to be queued once."""
    begun = local_trunc(unit, now)
    return jobs.groupBy("kind").agg(F.count_if((F.col(at) >= begun) & (F.col(at) <= now)).alias("n")).where("n = 0").select("kind")


def soon(occurrences: DataFrame, claims: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Sources one of whose events takes place within the next hours. claims: event_id, source_id."""
    away = F.unix_seconds(F.col("starts_at").cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))
    near = occurrences.where((F.col("status") == "scheduled") & away.between(0, hours * 3600)).select("event_id")
    return claims.join(near, "event_id", "left_semi").select("source_id").distinct()


def qa_sample(occurrences: DataFrame, now: Column, n: int, key: str = "occurrence_id", seed: int = 0) -> DataFrame:
    """Occurrences to check: four fifths observed ones of the next fortnight, one fifth projected ones of the six weeks after; each stratum by the order of a hash."""
    c = F.col
    days = (F.unix_seconds(c("starts_at").cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 86400
    ready_ = occurrences.where((c("status") == "scheduled") & c("url").isNotNull()).withColumn("_d", days)
    fifth = max(1, n // 5)
    near = sample(ready_.where(c("_d").between(0, 14) & ~c("projected")), key, n - fifth, seed).withColumn("stratum", F.lit("near"))
    far = sample(ready_.where(c("_d").between(14, 56) & c("projected")), key, fifth, seed).withColumn("stratum", F.lit("projected"))
    return near.unionByName(far).drop("_d")


def coverage(found: DataFrame, known: DataFrame, least: float = 0.9, named: int = 5) -> DataFrame:
    """Of each source what share of an independent extraction is known by its fingerprint, the first few titles that are not, and whether that is too little.

    found and known: source_id, fingerprint; found also title.
    """
    k = known.select("source_id", "fingerprint").distinct().withColumn("_known", F.lit(True))
    rows = found.join(k, ["source_id", "fingerprint"], "left")
    rank = F.row_number().over(Window.partitionBy("source_id", "_known").orderBy("title", "fingerprint"))
    rows = rows.withColumn("_n", F.when(F.col("_known").isNull(), rank))
    missing = F.array_sort(F.collect_list(F.when(F.col("_n") <= named, F.struct("_n", "title"))))
    out = rows.groupBy("source_id").agg(F.count("*").alias("n_found"), F.count("_known").alias("n_known"), missing.alias("m"))
    share = F.col("n_known") / F.col("n_found")
    return out.select("source_id", "n_found", "n_known", share.alias("coverage"), F.transform("m", lambda x: x["title"]).alias("missing"), ((share < least) & (F.col("n_known") < F.col("n_found"))).alias("below"))


def lately(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """What is remembered: rows of the last days (rejected domains 90, an agent's last visit 7, a tried event 30)."""
    return rows.where(F.unix_micros(F.col(at).cast("timestamp")) > F.unix_micros(now.cast("timestamp")) - days * 86_400_000_000)


def audits(events: DataFrame, claims: DataFrame, identity: DataFrame, aggregators: str, box: tuple[float, float, float, float], now: Column, days: int = 7) -> DataFrame:
    """What people should look at: check, key, and how many. Coming events without a place of which all sources are aggregators, events outside the box
    (south, west, north, east), and aggregators' new claims that became no event.

    events: event_id, venue_id, lat, lon, starts_at. claims: fingerprint, source_name, extracted_at. identity: fingerprint, event_id.
    """
    c = F.col
    outer = c("source_name").rlike(f"(?i){aggregators}")
    owners = identity.select("fingerprint", "event_id").join(claims.select("fingerprint", "source_name"), "fingerprint")
    only = owners.groupBy("event_id").agg(F.every(outer).alias("all_outer")).where("all_outer")
    lost = events.where(c("venue_id").isNull() & c("lat").isNull() & (c("starts_at") > now)).join(only, "event_id", "left_semi")
    south, west, north, east = box
    away = events.where(c("lat").isNotNull() & ~(c("lat").between(south, north) & c("lon").between(west, east)))
    new = lately(claims.where(outer), "extracted_at", now, days).join(identity, "fingerprint", "left_anti")
    count = lambda rows, check, key: rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "key", "n")
    return count(lost, "placeless", c("event_id")).unionByName(count(away, "outside", c("event_id"))).unionByName(count(new, "unresolved", c("source_name")))


def digest(counts: DataFrame, anomalies_: DataFrame, spent: DataFrame) -> DataFrame:
    """Lines of a daily report, in order: totals (name, n), anomalous days (day, n, median), spend (today, month)."""
    line = lambda df, rank, text_: df.select(F.lit(rank).alias("rank"), text_.alias("line"))
    parts = [
        line(counts, 1, F.format_string("%s: %d", "name", "n")),
        line(anomalies_, 2, F.format_string("day %s: %d events, usually %.1f", F.col("day").cast("string"), "n", F.col("median").cast("double"))),
        line(spent, 3, F.format_string("spent today %.2f, this month %.2f", "today", "month")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("rank", "line")
