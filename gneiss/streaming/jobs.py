"""Streams of events and job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gneiss.operators.ordered import chunk_summaries, streamed
from gneiss.sources.scratch import scratch_path

#: How long telemetry is kept.
RETENTION = "12 hours"
#: Status changes that a job may go through.
JOB_TRANSITIONS = {
    "queued": ("running", "failed"),
    "running": ("completed", "failed", "cancelled"),
    "failed": ("queued",),
    "completed": (),
    "cancelled": ("queued",),
}


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of a Parquet folder, or of one file, as a stream in the files' schema."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        stream, path = stream.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def with_expiry(events: DataFrame, at: str = "ts") -> DataFrame:
    """Rows with the time at which they may be deleted."""
    return events.withColumn("expires_at", F.col(at) + F.expr(f"INTERVAL {RETENTION}"))


def telemetry_windows(events: DataFrame, size: str = "1 hour", late: str = RETENTION) -> DataFrame:
    """Counts and sums for each hour and type; rows later than the watermark are left out, and state is dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap; where the client names its session, group by that instead."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = RETENTION) -> DataFrame:
    """Each key once within the watermark, so a repeated delivery has no effect."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def keep_recent(events: DataFrame, as_of: str, at: str = "ts") -> DataFrame:
    """Events that have not expired at a time: what a clean-up of telemetry leaves."""
    return with_expiry(events, at).where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))


def tail(events: DataFrame, key: str, n: int, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last ``n`` events of each key, newest first, numbered from 1."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return events.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def advance_sequences(enrollments: DataFrame, steps: DataFrame) -> DataFrame:
    """Enrollments after their present step: whether it is sent, and the next step with its time, or the end.

    ``enrollments`` has (enrollment_id, sequence_id, step, variant, due), ``steps`` (sequence_id, step,
    day_offset, target). A step is sent if its target is the enrollment's variant or CONTROL; with or without
    that the enrollment moves on, to ``day_offset`` days of the next step after it was due.
    """
    now = steps.select("sequence_id", "step", F.col("target").alias("_target"))
    after = steps.select("sequence_id", (F.col("step") - 1).alias("step"), F.col("day_offset").alias("_days"))
    joined = enrollments.join(now, ["sequence_id", "step"], "left").join(after, ["sequence_id", "step"], "left")
    sent = F.coalesce((F.col("_target") == F.col("variant")) | (F.col("_target") == "CONTROL"), F.lit(False))
    more = F.col("_days").isNotNull()
    return joined.select(
        "enrollment_id",
        sent.alias("sent"),
        F.when(more, F.col("step") + 1).otherwise(F.col("step")).alias("step"),
        F.when(more, "ACTIVE").otherwise("COMPLETED").alias("status"),
        F.when(more, F.col("due") + F.make_dt_interval(F.col("_days"))).alias("due"),
    )


def rate_limit(events: DataFrame, limit: int, window_ms: int, key: str = "user_id") -> DataFrame:
    """(key, ts, allowed, retry_after_s) of a sliding log: denied calls are not recorded, hence state.

    Works on a batch or a stream. State is at most ``limit`` times for a key, and in a stream a key unused for
    a window is forgotten. A batch is streamed in order of time through one task for each key.
    """

    def call(times: list[int], now: int) -> tuple[bool, int]:
        times[:] = [t for t in times if t > now - window_ms]
        if len(times) >= limit:
            return False, -(-(times[0] + window_ms - now) // 1000)
        times.append(now)
        return True, 0

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("ts")
        stamps = (rows["ts"].astype("int64") // _per_ms(rows["ts"])).tolist()
        out = [call(times, now) for now in stamps]
        state.update((times,))
        state.setTimeoutTimestamp(max(stamps[-1] + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy(), "allowed": [a for a, _ in out], "retry_after_s": [r for _, r in out]})

    rows = events.select(key, "ts")
    if not events.isStreaming:
        timed = rows.withColumn("_ms", F.unix_millis("ts"))
        step = lambda times, row: ((row[0], *call(times, row[1])),)
        return streamed(timed, [key], ["ts"], ["ts", "_ms"], "ts timestamp, allowed boolean, retry_after_s bigint", list, step)
    schema = f"{key} {dict(rows.dtypes)[key]}, ts timestamp, allowed boolean, retry_after_s bigint"
    timed = rows.withWatermark("ts", f"{window_ms} milliseconds")
    return timed.groupBy(key).applyInPandasWithState(update, schema, "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def _per_ms(times: pd.Series) -> int:
    """Units of a timestamp column in a millisecond."""
    return {"ns": 1_000_000, "us": 1_000, "ms": 1}[times.dt.unit]


def fixed_window_limit(events: DataFrame, limit: int, window_ms: int, key: str = "user_id") -> DataFrame:
    """(key, ts, allowed) of a window that starts anew with the first call after it has expired.

    The window's start depends on the calls before, not on the clock, so a key's calls are streamed in order.
    """

    def step(state: list, row: tuple) -> tuple:
        ts, now = row
        if not state or now - state[0] >= window_ms:
            state[:] = now, 0
        state[1] += 1
        return ((ts, state[1] <= limit),)

    timed = events.select(key, "ts", F.unix_millis("ts").alias("_ms"))
    return streamed(timed, [key], ["ts"], ["ts", "_ms"], "ts timestamp, allowed boolean", list, step)


def job_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, status, illegal): each job's last status; a change that isn't allowed is counted and ignored.

    Events of one time are taken in order of status. For each range of a job's events a table says where each
    status leads and how many changes are illegal on the way; the tables are then applied in order, so a job
    with very many events spreads over many tasks.
    """
    names = list(JOB_TRANSITIONS)

    def step(table: list, row: tuple) -> tuple:
        for at, (status, illegal) in enumerate(table):
            ok = row[0] in JOB_TRANSITIONS[status]
            table[at] = (row[0], illegal) if ok else (status, illegal + 1)
        return ()

    end = lambda table: ([names.index(s) for s, _ in table], [n for _, n in table])
    parts = chunk_summaries(events, [key], ["ts", "status"], ["status"], "to array<int>, illegal array<bigint>", lambda: [(s, 0) for s in names], step, end)
    rows = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", "to", "illegal"))).alias("s"))
    start = F.struct(F.lit(names.index("queued")).alias("at"), F.lit(0).cast("bigint").alias("illegal"))
    apply = lambda s, x: F.struct(F.get(x["to"], s["at"]).alias("at"), (s["illegal"] + F.get(x["illegal"], s["at"])).alias("illegal"))
    done = rows.select(key, F.aggregate("s", start, apply).alias("r"))
    return done.select(key, F.get(F.array(*map(F.lit, names)), F.col("r.at")).alias("status"), F.col("r.illegal").alias("illegal"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now; its rows are written to the scratch folder and read from there.

    In ``complete`` mode the last batch is the whole result.
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", path)
    else:
        sink = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    sink.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
