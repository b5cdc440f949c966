"""Stateful operators and streams over the event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.sources import sinks
from gneiss.sources.manifest import HourlyLog, KeyedTable
from gneiss.sources.scratch import scratch_path
from gneiss.streaming import jobs, stateful
from gneiss.workloads.base import query


def _arriving(t, events: DataFrame, stream_of: Callable[[DataFrame], DataFrame], late: bool = True, runs: int = 2) -> DataFrame:
    """What a stream gives out over events that arrive in ``runs`` parts, each taken in by a run that goes on from the last.

    Parts follow each other in time, but events come up to an hour too early or too late; with ``late`` a last row without a
    key lets the watermark pass them all.
    """
    path, out = scratch_path(t.spark, "arriving"), scratch_path(t.spark, "given-out")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    jitter = F.unix_micros("ts") + (F.col("event_id") % 7 - 3) * 600_000_000
    part = F.floor((jitter - first) * runs / (last - first + 1))
    for n in range(runs):
        here = (part <= n) if n == 0 else (part >= n) if n == runs - 1 else (part == n)
        events.where(here).write.mode("append").parquet(path)
        if late and n == runs - 1:
            stateful.closing_row(events, "user_id").write.mode("append").parquet(path)
        given = stateful.run_to(stream_of(jobs.read_events(t.spark, path, 1000)), out)
    return given


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_event_windows(t) -> DataFrame:
    """Hourly windows, read as a stream and run over all that is there."""
    stream = jobs.telemetry_windows(jobs.read_events(t.spark, f"{t.folder}/events.parquet"), late="0 seconds")
    out = jobs.run_available(stream, "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


@query("SELECT event_id, strftime(date_trunc('second', ts + INTERVAL 12 HOUR), '%Y-%m-%d %H:%M:%S') AS expires FROM events WHERE ts + INTERVAL 12 HOUR > TIMESTAMP '2024-01-03'")
def sink_telemetry(t) -> DataFrame:
    """Telemetry written with its expiry, and what a later clean-up leaves of it."""
    path, kept = scratch_path(t.spark, "telemetry"), scratch_path(t.spark, "kept")
    jobs.with_expiry(t.events).write.parquet(path)
    sinks.delete_where(t.spark, path, kept, F.col("expires_at") <= F.lit("2024-01-03").cast("timestamp"))
    return t.spark.read.parquet(kept).select("event_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
g AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, count(DISTINCT g) AS n_sessions, count(*) AS n_events FROM g GROUP BY 1""")
def stream_sessions(t) -> DataFrame:
    """Sessions by a gap of 30 minutes, from a stream."""
    stream = jobs.sessions(jobs.read_events(t.spark, f"{t.folder}/events.parquet"))
    return jobs.run_available(stream, "complete").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT user_id, n, [ms] AS log, TRUE AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, CASE WHEN len(log) >= 5 THEN log ELSE list_append(log, ms) END, len(log) < 5 FROM
    (SELECT e.user_id, e.n, e.ms, list_filter(r.log, lambda x: x > e.ms - 3600000) AS log FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, count(*) AS n_calls, count(*) FILTER (WHERE allowed) AS n_allowed FROM r GROUP BY 1""")
def stream_rate_limiter(t) -> DataFrame:
    """Calls that a sliding log of five an hour allows, from a stream with state."""
    stream = jobs.rate_limit(jobs.read_events(t.spark, f"{t.folder}/events.parquet"), 5, 3_600_000)
    return jobs.run_available(stream).groupBy("user_id").agg(F.count("*").alias("n_calls"), F.sum(F.col("allowed").cast("bigint")).alias("n_allowed"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT user_id, n, ms AS start, 1 AS k FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN e.ms - r.start >= 3600000 THEN e.ms ELSE r.start END, CASE WHEN e.ms - r.start >= 3600000 THEN 1 ELSE r.k + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, count(*) AS n_calls, count(*) FILTER (WHERE k <= 3) AS n_allowed FROM r GROUP BY 1""")
def stream_fixed_window_limiter(t) -> DataFrame:
    """Three calls for each window that opens with a call after the last one has ended, over events that arrive out of order."""
    calls = _arriving(t, t.events, lambda e: stateful.fixed_window_calls(e, 3, 3_600_000, late="3 hours"))
    return calls.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n_calls"), F.sum(F.col("allowed").cast("bigint")).alias("n_allowed"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS s, ts FROM events),
o AS (SELECT job_id, s, row_number() OVER (PARTITION BY job_id ORDER BY ts, s) AS n FROM e),
r AS (SELECT job_id, CAST(0 AS BIGINT) AS n, 'queued' AS status, CAST(0 AS BIGINT) AS illegal FROM (SELECT DISTINCT job_id FROM o)
  UNION ALL SELECT o.job_id, o.n, CASE WHEN r.status || '>' || o.s IN ('queued>running', 'queued>failed', 'running>completed', 'running>failed', 'running>cancelled', 'failed>queued', 'cancelled>queued') THEN o.s ELSE r.status END,
    r.illegal + CASE WHEN r.status || '>' || o.s IN ('queued>running', 'queued>failed', 'running>completed', 'running>failed', 'running>cancelled', 'failed>queued', 'cancelled>queued') THEN 0 ELSE 1 END
  FROM r JOIN o ON o.job_id = r.job_id AND o.n = r.n + 1)
SELECT job_id, arg_max(status, n) AS status, max(illegal) AS illegal FROM r GROUP BY 1""")
def stream_job_states(t) -> DataFrame:
    """Jobs moved by events that arrive out of order; changes that are not allowed are counted."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "queued").otherwise("running")
    changes = _arriving(t, t.events, lambda e: stateful.job_changes(e.select(F.col("user_id").alias("job_id"), "ts", status.alias("status")), late="3 hours"))
    return stateful.job_status(changes.where("job_id IS NOT NULL"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3")
def stream_event_tail(t) -> DataFrame:
    """The last three events of each user, from rows that were given out as they came among them, in three runs."""
    added = _arriving(t, t.events, lambda e: stateful.added_to_tail(e, "user_id", 3, "event_id"), late=False, runs=3)
    return jobs.tail(added.withColumnRenamed("id", "event_id"), "user_id", 3).select("user_id", "event_id", F.col("place").cast("bigint").alias("place"))


@query("SELECT event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1")
def stream_retention(t) -> DataFrame:
    """A log by the hour, its expired hours dropped and their files deleted."""
    log = HourlyLog(t.spark, scratch_path(t.spark, "log"))
    for half in (0, 1):
        log.append(t.events.where(F.col("event_id") % 2 == half), half)
    log.expire("2024-01-02 00:00:00", 12)
    log.vacuum(keep=1)
    return log.read().groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT c.user_id, c.event_id AS first_id, p.event_id AS then_id, epoch_us(p.ts) - epoch_us(c.ts) AS micros
FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR""")
def stream_interval_join(t) -> DataFrame:
    """Purchases within an hour of a click, from two streams that arrive out of order."""
    of = lambda e, kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    pairs = _arriving(t, t.events, lambda e: stateful.followed(of(e, "click"), of(e, "purchase"), "user_id", "1 hour", "3 hours"), late=False)
    return pairs.select("user_id", "first_id", "then_id", (F.unix_micros("then_ts") - F.unix_micros("first_ts")).alias("micros"))


@query("""WITH s(seq, step, days, target) AS (VALUES (0, 0, 0, 'A'), (0, 1, 2, 'CONTROL'), (0, 2, 5, 'B'), (1, 0, 0, 'CONTROL'), (1, 1, 7, 'A')),
e AS (SELECT o_orderkey, o_orderkey % 2 AS seq, o_custkey % 3 AS step, CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'A' END AS variant, o_orderdate AS due FROM orders)
SELECT e.o_orderkey AS enrollment_id, coalesce(n.target = e.variant OR n.target = 'CONTROL', FALSE) AS sent, CASE WHEN x.days IS NULL THEN e.step ELSE e.step + 1 END AS step,
  CASE WHEN x.days IS NULL THEN 'COMPLETED' ELSE 'ACTIVE' END AS status, strftime(due + x.days * INTERVAL 1 DAY, '%Y-%m-%d') AS due
FROM e LEFT JOIN s n ON n.seq = e.seq AND n.step = e.step LEFT JOIN s x ON x.seq = e.seq AND x.step = e.step + 1""")
def stream_drip_sequences(t) -> DataFrame:
    """Enrollments one step on."""
    steps = t.spark.createDataFrame([(0, 0, 0, "A"), (0, 1, 2, "CONTROL"), (0, 2, 5, "B"), (1, 0, 0, "CONTROL"), (1, 1, 7, "A")], "sequence_id long, step long, day_offset int, target string")
    variant = F.when(F.col("o_orderkey") % 3 == 0, "B").otherwise("A")
    e = t.orders.select(F.col("o_orderkey").alias("enrollment_id"), (F.col("o_orderkey") % 2).alias("sequence_id"), (F.col("o_custkey") % 3).alias("step"), variant.alias("variant"), F.col("o_orderdate").cast("timestamp").alias("due"))
    return jobs.advance_sequences(e, steps).withColumn("due", F.date_format("due", "yyyy-MM-dd"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def sink_upsert_by_key(t) -> DataFrame:
    """Newest row of each key, after three batches that were upserted into a table, one of them twice."""
    table = KeyedTable(t.spark, scratch_path(t.spark, "upserted"), "user_id", "ts", buckets=16)
    for batch in (0, 1, 1, 2):
        table.upsert(t.events.where(F.col("event_id") % 3 == batch).select("user_id", "ts", "event_id"), batch)
    return table.read().select("user_id", "event_id")


@query("""SELECT user_id, arg_max(event_type, (event_id % 3, ts, event_id)) AS last_type, arg_max(value, (event_id % 3, ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_spent FROM events GROUP BY 1""")
def sink_upsert_merge(t) -> DataFrame:
    """Rows merged into a table: what a row lacks stays as it was."""
    table = KeyedTable(t.spark, scratch_path(t.spark, "merged"), "user_id", "at", buckets=16, merge=True)
    spent = F.when(F.col("event_type") == "purchase", F.col("value"))
    rows = t.events.select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("last_type"), spent.alias("last_spent"))
    for batch in range(3):
        table.upsert(rows.where(F.col("event_id") % 3 == batch).select("user_id", "at", "last_type"), 2 * batch)
        table.upsert(rows.where((F.col("event_id") % 3 == batch) & F.col("last_spent").isNotNull()).select("user_id", "at", "last_spent"), 2 * batch + 1)
    return table.read().select("user_id", "last_type", "last_spent")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error' AND value < 50)")
def sink_delete_where(t) -> DataFrame:
    """What a conditional delete leaves of a written table."""
    path, out = scratch_path(t.spark, "events"), scratch_path(t.spark, "left")
    t.events.write.parquet(path)
    sinks.delete_where(t.spark, path, out, (F.col("event_type") == "error") & (F.col("value") < 50))
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("""SELECT p_partkey, 'price' AS field, p_retailprice AS before, p_retailprice * 1.25 AS after FROM part WHERE p_size > 45
UNION ALL SELECT p_partkey, 'size', p_size, p_size + 1 FROM part WHERE p_size < 3""")
def sink_audit_log(t) -> DataFrame:
    """Changes appended to a log, with what stood there before."""
    path = scratch_path(t.spark, "audit")
    changes = ((t.part.where("p_size > 45"), "price", F.col("p_retailprice"), F.col("p_retailprice") * 1.25), (t.part.where("p_size < 3"), "size", F.col("p_size"), F.col("p_size") + 1))
    for rows, field, before, after in changes:
        rows.select("p_partkey", F.lit(field).alias("field"), before.cast("double").alias("before"), after.cast("double").alias("after")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)
