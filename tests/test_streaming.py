"""Streams and stateful folds against plain versions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gneiss.sources.manifest import HourlyLog, KeyedTable
from gneiss.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)


def plain_sliding(times, limit, window):
    kept, out = [], []
    for now in times:
        kept = [t for t in kept if t > now - window]
        if len(kept) >= limit:
            out.append((False, -(-(kept[0] + window - now) // 1000)))
        else:
            kept.append(now)
            out.append((True, 0))
    return out


def calls(spark):
    rows = [(u, T0 + timedelta(seconds=s)) for u in (1, 2) for s in (0, 10, 20, 30, 59, 61, 65, 200 * u, 200 * u + 1)]
    return rows, spark.createDataFrame(rows, "user_id long, ts timestamp")


def test_rate_limiter_counts_only_allowed_calls(spark):
    rows, df = calls(spark)
    got = jobs.rate_limit(df, 3, 60_000).orderBy("user_id", "ts").collect()
    for u in (1, 2):
        times = sorted(int((t - T0).total_seconds() * 1000) for k, t in rows if k == u)
        assert [(r.allowed, r.retry_after_s) for r in got if r.user_id == u] == plain_sliding(times, 3, 60_000)


def test_rate_limiter_as_a_stream(spark, tmp_path):
    _, df = calls(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.rate_limit(jobs.read_events(spark, str(tmp_path / "in"), 100), 3, 60_000)
    got = jobs.run_available(stream)
    key = lambda r: (r.user_id, r.ts)
    assert sorted(got.collect(), key=key) == sorted(jobs.rate_limit(df, 3, 60_000).collect(), key=key)


def test_fixed_window_starts_with_the_first_call(spark):
    df = spark.createDataFrame([(1, T0 + timedelta(seconds=s)) for s in (5, 6, 7, 64, 65, 66)], "user_id long, ts timestamp")
    assert [r.allowed for r in jobs.fixed_window_limit(df, 2, 60_000).orderBy("ts").collect()] == [True, True, False, False, True, True]


def test_job_states(spark):
    steps = [("a", 1, "running"), ("a", 2, "completed"), ("a", 3, "running"), ("b", 1, "completed"), ("b", 2, "running"), ("b", 3, "failed"), ("b", 4, "queued")]
    df = spark.createDataFrame([(j, T0 + timedelta(seconds=s), x) for j, s, x in steps], "job_id string, ts timestamp, status string")
    assert {(r.job_id, r.status, r.illegal) for r in jobs.job_states(df).collect()} == {("a", "completed", 1), ("b", "queued", 1)}


def folders(table):
    return {p: f[0] for p, f in table.manifest()["parts"].items()}


def test_upsert_keeps_the_newest_row_and_rewrites_touched_parts_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "at", buckets=8)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, at long, v string")
    table.upsert(batch(*((f"k{i}", 1, "first") for i in range(200))), 0)
    before, reader = folders(table), table.read()
    assert len(before) == 8
    changed = batch(("k7", 2, "new"), ("k8", 0, "old"))
    touched = table.upsert(changed, 1)
    assert 1 <= len(touched) <= 2
    after = folders(table)
    assert {p for p in after if after[p] != before[p]} == set(touched)
    assert table.upsert(changed, 1) == [] and folders(table) == after
    rows = {r.k: (r.at, r.v) for r in table.read().collect()}
    assert len(rows) == 200 and rows["k7"] == (2, "new") and rows["k8"] == (1, "first")
    assert reader.where("k = 'k7'").first().v == "first"  # a reader of the version before is undisturbed
    with pytest.raises(ValueError):
        table.upsert(changed, 3)
    table.upsert(batch(), 2)
    assert folders(table) == after
    gone = table.vacuum(keep=1)
    assert {before[p] for p in touched} <= set(gone) and table.read().count() == 200


def test_upsert_merges_what_a_row_lacks(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "at", merge=True)
    table.upsert(spark.createDataFrame([("a", 1, "x", 5)], "k string, at long, v string, n int"), 0)
    table.upsert(spark.createDataFrame([("a", 2, "y")], "k string, at long, v string"), 1)
    table.upsert(spark.createDataFrame([("a", 3, None, 7)], "k string, at long, v string, n int"), 2)
    assert [tuple(r) for r in table.read().select("k", "at", "v", "n").collect()] == [("a", 3, "y", 7)]


def test_upsert_as_a_sink_goes_on_after_a_restart(spark, tmp_path):
    path, table = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), "user_id", "ts")
    for n in range(2):
        spark.createDataFrame([(u, T0 + timedelta(hours=n)) for u in (n, n + 1)], "user_id long, ts timestamp").write.mode("append").parquet(path)
        stream = jobs.read_events(spark, path, 100).writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "state"))
        stream.trigger(availableNow=True).start().awaitTermination()
    assert {(r.user_id, r.ts) for r in table.read().collect()} == {(0, T0), (1, T0 + timedelta(hours=1)), (2, T0 + timedelta(hours=1))}


def test_a_log_by_the_hour_expires(spark, tmp_path):
    log = HourlyLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(i, T0 + timedelta(minutes=30 * i)) for i in range(12)] + [(99, None)], "id long, ts timestamp")
    for half in (0, 1, 1):  # the second batch comes twice
        log.append(rows.where(F.col("id") % 2 == half), half)
    assert log.read().count() == 13
    reader = log.read()
    assert log.expire("2024-01-01 14:30:00", 12) == ["2024010100", "2024010101"]
    assert log.expire("2024-01-01 14:30:00", 12) == []
    assert sorted(r.id for r in log.read().collect()) == [*range(4, 12), 99]
    assert reader.count() == 13  # its files are there until the version before goes
    gone = log.vacuum(keep=1)
    assert len(gone) == 4 and not any((tmp_path / "log" / f).exists() for f in gone)
    assert log.read().count() == 9


def arriving(spark, tmp_path, parts, schema, stream_of):
    """Rows of each part as new files, each followed by a run that goes on from the one before."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = stateful.run_to(stream_of(jobs.read_events(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"))
    return out


def test_job_changes_out_of_order_and_late(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    first = [("a", at(5), "completed"), ("a", at(0), "running"), ("b", at(2), "completed")]
    second = [("a", at(200), "queued"), ("b", at(30), "running"), ("b", at(31), "failed"), ("b", at(32), "queued")]
    third = [("a", at(6), "running"), ("b", at(400), "cancelled"), ("c", at(10_000), "running")]
    out = arriving(spark, tmp_path, [first, second, third], "job_id string, ts timestamp, status string", lambda e: stateful.job_changes(e, late="1 hour"))
    rows = {(r.job_id, r.ts, r.value): (r.before, r.legal) for r in out.collect()}
    assert rows["a", at(0), "running"] == ("queued", True) and rows["a", at(5), "completed"] == ("running", True)
    assert ("a", at(6), "running") not in rows
    assert rows["a", at(200), "queued"] == ("completed", False) and rows["b", at(2), "completed"] == ("queued", False)
    done = {r.job_id: (r.status, r.illegal) for r in stateful.job_status(out).collect()}
    assert done == {"a": ("completed", 1), "b": ("queued", 2)}
    kept = spark.createDataFrame([x for x in first + second + third[1:2]], "job_id string, ts timestamp, status string")
    assert {r.job_id: (r.status, r.illegal) for r in jobs.job_states(kept).collect()} == done


def test_fixed_window_as_a_stream_is_the_batch_fold(spark, tmp_path):
    seconds = [5, 6, 7, 64, 65, 66, 200, 201, 202, 500]
    rows = [(u, T0 + timedelta(seconds=s * u)) for u in (1, 2) for s in seconds]
    parts = [[r for r in rows if r[1] < T0 + timedelta(seconds=150)][::-1], [r for r in rows if r[1] >= T0 + timedelta(seconds=150)] + [(9, T0 + timedelta(days=9))]]
    out = arriving(spark, tmp_path, parts, "user_id long, ts timestamp", lambda e: stateful.fixed_window_calls(e, 2, 60_000, late="10 minutes"))
    batch = jobs.fixed_window_limit(spark.createDataFrame(rows, "user_id long, ts timestamp"), 2, 60_000)
    assert {tuple(r) for r in out.where("user_id < 9").select("user_id", "ts", "allowed").collect()} == {tuple(r) for r in batch.collect()}


def test_tail_gives_out_each_row_once(spark, tmp_path):
    row = lambda i, m: (i, i % 2, T0 + timedelta(minutes=m))
    parts = [[row(0, 0), row(2, 2), row(4, 4), row(1, 1)], [row(6, 1), row(8, 9), row(4, 4)], [row(10, 3), row(3, 0)]]
    out = arriving(spark, tmp_path, parts, "event_id long, user_id long, ts timestamp", lambda e: stateful.added_to_tail(e, "user_id", 2, "event_id"))
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 8]
    assert {(r.user_id, r.id) for r in jobs.tail(out, "user_id", 2, tie="id").collect()} == {(0, 8), (0, 4), (1, 1), (1, 3)}
    seen = stateful.after_cursor(out, (T0 + timedelta(minutes=2), 2))
    assert sorted(r.id for r in seen.collect()) == [4, 8] and stateful.after_cursor(out, None).count() == 5


def test_interval_join_drops_late_rows(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    of = lambda e, kind: e.where(F.col("kind") == kind).select("u", "id", "ts")
    parts = [[(1, 1, "a", at(0)), (1, 2, "b", at(30)), (1, 3, "b", at(61))], [(2, 4, "b", at(10)), (2, 5, "a", at(5)), (3, 6, "a", at(900)), (3, 7, "b", at(900))], [(1, 8, "b", at(40)), (3, 9, "b", at(955))]]
    out = arriving(spark, tmp_path, parts, "u long, id long, kind string, ts timestamp", lambda e: stateful.followed(of(e, "a"), of(e, "b"), "u", "1 hour", "30 minutes"))
    assert {(r.first_id, r.then_id) for r in out.collect()} == {(1, 2), (5, 4), (6, 7), (6, 9)}


def test_folds_do_not_depend_on_partitions(spark):
    import random

    from gneiss.operators import ordered

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice(["queued", "running", "completed", "failed", "cancelled"]), float(rng.randint(-60, 60))) for i in range(2000)]
    df = spark.createDataFrame(rows, "job_id long, ts long, status string, d double")
    score, state, illegal = {1: 0.0, 2: 0.0}, {1: "queued", 2: "queued"}, {1: 0, 2: 0}
    for k, _, s, d in rows:
        score[k] = min(100.0, max(0.0, score[k] + d))
        if s in jobs.JOB_TRANSITIONS[state[k]]:
            state[k] = s
        else:
            illegal[k] += 1
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            assert {r.job_id: r.score for r in ordered.clamped_score(df, ["job_id"], "ts", "ts", "d").collect()} == score
            assert {r.job_id: (r.status, r.illegal) for r in jobs.job_states(df).collect()} == {k: (state[k], illegal[k]) for k in state}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tail_retention_and_sequences(spark):
    df = spark.createDataFrame([(i, i % 2, T0 + timedelta(hours=i)) for i in range(10)], "event_id long, user_id long, ts timestamp")
    assert {(r.user_id, r.event_id) for r in jobs.tail(df, "user_id", 2).collect()} == {(0, 8), (0, 6), (1, 9), (1, 7)}
    assert jobs.keep_recent(df, "2024-01-01 15:00:00").count() == 6
    steps = spark.createDataFrame([(0, 0, 0, "A"), (0, 1, 2, "CONTROL")], "sequence_id long, step long, day_offset int, target string")
    e = spark.createDataFrame([(1, 0, 0, "B", T0), (2, 0, 1, "B", T0), (3, 9, 0, "A", T0)], "enrollment_id long, sequence_id long, step long, variant string, due timestamp")
    got = {r.enrollment_id: (r.sent, r.step, r.status, r.due) for r in jobs.advance_sequences(e, steps).collect()}
    assert got == {1: (False, 1, "ACTIVE", T0 + timedelta(days=2)), 2: (True, 1, "COMPLETED", None), 3: (False, 0, "COMPLETED", None)}


def test_repeats_count_once(spark, tmp_path):
    df = spark.createDataFrame([(1, T0), (1, T0), (2, T0 + timedelta(minutes=5))], "event_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    assert jobs.run_available(jobs.once(jobs.read_events(spark, str(tmp_path / "in"), 100))).agg(F.count("*")).first()[0] == 2
