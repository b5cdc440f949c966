"""Streams that hold rows back until they are in order, and streams that keep the tail of each key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gneiss.streaming.jobs import JOB_TRANSITIONS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(spark: SparkSession) -> None:
    """State in lists and timers needs the store on disk; a setting of the user's own that can hold them is kept."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, STORE)


def _micros(times: pd.Series) -> list[int]:
    return (times.astype("int64") // {"ns": 1000, "us": 1, "ms": 1}[times.dt.unit] * {"ms": 1000}.get(times.dt.unit, 1)).tolist()


def _as_text(key: str) -> Column:
    """A key as a text that is never null: pandas would turn whole numbers beside a null into fractions."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias(key)


def _back(out: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The key as it was in ``events``."""
    own = F.when(F.col(key) != "", F.substring(F.col(key), F.lit(2), F.length(key))).cast(dict(events.dtypes)[key])
    return out.select(*(own.alias(c) if c == key else F.col(c) for c in out.columns))


def _times(micros: Iterable[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(list(micros), unit="us"))


def _frame(columns: dict) -> pd.DataFrame:
    """Plain objects in all columns but times: Arrow takes no other kind of texts here."""
    return pd.DataFrame({c: v if isinstance(v, pd.Series) else pd.Series(v, dtype=object) for c, v in columns.items()})


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them to ``step`` in order of time and value.

    State: what ``step`` carries, as numbers and texts (``state``), and the rows that wait, which the watermark's delay
    bounds. A timer at the first waiting row's time wakes the key, which then hands over all that the watermark has passed and
    sets the next one: timers are as many as wake-ups, not as rows. Rows that come after the watermark has passed them
    are dropped before they get here. ``idle_ms`` after its last row a key is forgotten, if that is set.
    """

    def __init__(self, key: str, start: tuple, state: str, step: Callable[[tuple, int, str], tuple[tuple, tuple]], columns: list[str], idle_ms: int | None = None):
        self.key, self.start, self.schema, self.step, self.columns, self.idle_ms = key, start, state, step, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.schema}, last bigint")
        self.waiting = handle.getListState("waiting", "us bigint, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            wait = list(zip(_micros(part["ts"]), part["value"].tolist()))
            self.waiting.appendList(wait)
            first = min(wait)[0] if first is None else min(first, min(wait)[0])
        if first is not None:  # those that waited before have a timer of their own
            self.handle.registerTimer(first // 1000)
        yield from ()  # all rows wait

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[0] // 1000 <= passed]
        if due:
            rest = held[len(due) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
            *state, _ = self.state.get() if self.state.exists() else (*self.start, 0)
            out, state = [], tuple(state)
            for us, value in due:
                state, result = self.step(state, us // 1000, value)
                out.append((us, value, *result))
            self.state.update((*state, due[-1][0] // 1000))
            if rest:
                self.handle.registerTimer(rest[0][0] // 1000)
            elif self.idle_ms is not None:
                self.handle.registerTimer(due[-1][0] // 1000 + self.idle_ms)
            yield self._rows(key, out)
        elif self.idle_ms is not None and self.state.exists() and not held and self.state.get()[-1] + self.idle_ms <= passed:
            self.state.clear()

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        values = {self.key: [key[0]] * len(rows), "ts": _times(r[0] for r in rows)}
        return _frame(values | {c: [r[i] for r in rows] for i, c in enumerate(["value", *self.columns], 1)})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, value: str, late: str, start: tuple, state: str, step, results: dict[str, str], idle_ms: int | None = None) -> DataFrame:
    """(key, ts, value, results) for every row of a stream that isn't too late, as ``step`` gives them in order of time.

    ``results`` names the columns of what ``step`` returns besides the state, with their types.
    """
    _with_store(events.sparkSession)
    rows = events.select(_as_text(key), "ts", F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).withWatermark("ts", late)
    schema = ", ".join([f"`{key}` string, ts timestamp, value string", *(f"{c} {t}" for c, t in results.items())])
    processor = InOrder(key, start, state, step, list(results), idle_ms)
    return _back(rows.groupBy(key).transformWithStateInPandas(processor, StructType.fromDDL(schema), "Append", "EventTime"), events, key)


def job_changes(events: DataFrame, key: str = "job_id", late: str = "1 hour") -> DataFrame:
    """(key, ts, value, before, legal): every status that a job is given, in order of time, and whether it may be.

    A change that isn't allowed leaves the job as it was: rows with ``legal`` false are the second output. Events of one time
    are taken in order of status. Rows later than ``late`` behind the newest of the batches before are dropped.
    """

    def step(state: tuple, ms: int, status: str) -> tuple[tuple, tuple]:
        legal = status in JOB_TRANSITIONS[state[0]]
        return ((status,) if legal else state), (state[0], legal)

    return in_order(events, key, "status", late, ("queued",), "status string", step, {"before": "string", "legal": "boolean"})


def job_status(changes: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, status, illegal) from the rows of ``job_changes`` that were written."""
    after = F.when(F.col("legal"), F.col("value")).otherwise(F.col("before"))
    return changes.groupBy(key).agg(F.max_by(after, F.struct("ts", "value")).alias("status"), F.sum((~F.col("legal")).cast("bigint")).alias("illegal"))


def fixed_window_calls(events: DataFrame, limit: int, window_ms: int, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(key, ts, value, allowed): calls by a window that starts anew with the first call after it has ended.

    A key without calls for a window's length is forgotten, which changes nothing: its next call would start anew.
    """

    def step(state: tuple, ms: int, _: str) -> tuple[tuple, tuple]:
        start, n = state
        start, n = (ms, 1) if n == 0 or ms - start >= window_ms else (start, n + 1)
        return (start, n), (n <= limit,)

    marked = events.withColumn("_call", F.lit(""))
    return in_order(marked, key, "_call", late, (0, 0), "start bigint, n bigint", step, {"allowed": "boolean"}, window_ms)


class Tail(StatefulProcessor):
    """Keeps the last ``n`` rows of a key and gives out those of a batch that come among them."""

    def __init__(self, key: str, n: int):
        self.key, self.n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "us bigint, id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = set(map(tuple, self.last.get())) if self.last.exists() else set()
        now = set(before)
        for part in rows:  # at most n rows and one part are held
            now = set(sorted(now | set(zip(_micros(part["ts"]), part["id"].tolist())))[-self.n :])
        self.last.put(sorted(now))
        added = sorted(now - before)
        yield _frame({self.key: [key[0]] * len(added), "ts": _times(us for us, _ in added), "id": [i for _, i in added]})

    def close(self) -> None:
        pass


def added_to_tail(events: DataFrame, key: str, n: int, event_id: str) -> DataFrame:
    """(key, ts, id): rows of a stream that come among the last ``n`` of their key, by time and id, each once.

    State is ``n`` rows a key. A row that is repeated adds nothing while it is among them; rows without time or id are left out.
    """
    _with_store(events.sparkSession)
    rows = events.where(F.col(event_id).isNotNull() & F.col("ts").isNotNull()).select(_as_text(key), "ts", F.col(event_id).cast("bigint").alias("id"))
    schema = StructType.fromDDL(f"`{key}` string, ts timestamp, id bigint")
    return _back(rows.groupBy(key).transformWithStateInPandas(Tail(key, n), schema, "Append", "None"), events, key)


def after_cursor(added: DataFrame, cursor: tuple | None) -> DataFrame:
    """What a listener that has seen everything up to ``cursor`` (ts, id) has still to see; all if that is none."""
    if cursor is None:
        return added
    at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
    return added.where((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("id") > last)))


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """(key, first_id, first_ts, then_id, then_ts): pairs of two streams (key, id, ts), the second at most ``within`` later.

    Rows that come later than ``late`` behind their stream's newest are dropped. State of the first stream lasts for
    ``within`` and the delay, that of the second for the delay.
    """
    a = first.select(F.col(key).alias("_a"), F.col("id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select(F.col(key).alias(key), F.col("id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    near = (F.col("_a") == F.col(key)) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select(key, "first_id", "first_ts", "then_id", "then_ts")


def run_to(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what there is by now, on from where it stopped before; all rows that it ever gave out.

    Its state is kept beside ``path``, so a later call takes in new files alone.
    """
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def closing_row(events: DataFrame, key: str, days: int = 3650) -> DataFrame:
    """One row far behind all others, without a key: a last file of it lets a stream's watermark pass them."""
    last = events.agg((F.max("ts") + F.make_dt_interval(days=F.lit(days))).alias("ts"))
    return last.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes))
