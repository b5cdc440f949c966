"""Sessions, experiments, telemetry and lead rules over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.rules import ab_variant, job_status, qualify_lead
from gneiss.operators.aggregate import count_where
from gneiss.sources import sinks
from gneiss.sources.scratch import scratch_path
from gneiss.workloads.base import query


@query("""SELECT user_id AS session_id, date_diff('millisecond', min(ts), max(ts)) AS duration_ms, max(value) FILTER (WHERE event_type = 'view') AS max_scroll,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 4) AS watch_time, count(*) FILTER (WHERE event_type = 'view') AS n_views, count(*) AS n_events FROM events GROUP BY 1""")
def agg_session_metrics(t) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("session_id")).agg(
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("duration_ms"),
        F.max(F.when(kind == "view", F.col("value"))).alias("max_scroll"),
        F.round(F.coalesce(F.sum(F.when(kind == "click", F.col("value"))), F.lit(0.0)), 4).alias("watch_time"),
        count_where(kind == "view").alias("n_views"),
        F.count("*").alias("n_events"),
    )


@query("""WITH RECURSIVE u AS (SELECT DISTINCT 'u' || user_id AS unit FROM events), h AS (SELECT unit, 0 AS i, CAST(0 AS BIGINT) AS h FROM u UNION ALL
  SELECT unit, i + 1, ((h.h * 31 + ascii(substring(unit, i + 1, 1)) + 2147483648) & 4294967295) - 2147483648 FROM h WHERE i < length(unit)),
v AS (SELECT unit, abs(h) / 2147483647.0 AS x FROM h WHERE i = length(unit)),
a AS (SELECT CAST(substring(unit, 2) AS BIGINT) AS user_id, CASE WHEN x <= 0.5 THEN 'control' ELSE 'variant' END AS variant FROM v)
SELECT variant, count(DISTINCT user_id) AS impressions, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS conversions FROM events JOIN a USING (user_id) GROUP BY 1""")
def agg_ab_results(t) -> DataFrame:
    """Units and converted units of each variant, assigned by a rolling hash of the unit's name."""
    variant = ab_variant(F.concat(F.lit("u"), F.col("user_id").cast("string")), {"control": 50, "variant": 50})
    per = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought")).withColumn("variant", variant)
    return per.groupBy("variant").agg(F.count("*").alias("impressions"), count_where(F.col("bought")).alias("conversions"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT 'u' || user_id AS unit FROM events), h AS (SELECT unit, 0 AS i, CAST(0 AS BIGINT) AS h FROM u UNION ALL
  SELECT unit, i + 1, ((h.h * 31 + ascii(substring(unit, i + 1, 1)) + 2147483648) & 4294967295) - 2147483648 FROM h WHERE i < length(unit))
SELECT unit, CASE WHEN abs(h) / 2147483647.0 <= 0.2 THEN 'a' WHEN abs(h) / 2147483647.0 <= 0.5 THEN 'b' ELSE 'c' END AS variant FROM h WHERE i = length(unit)""")
def ab_variant_hash(t) -> DataFrame:
    units = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("unit")).distinct()
    return units.select("unit", ab_variant(F.col("unit"), {"a": 20, "b": 30, "c": 50}).alias("variant"))


@query("""WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS secs FROM events GROUP BY 1)
SELECT count(*) AS sessions, CAST(sum(views) AS BIGINT) AS views, round(avg(secs), 4) AS avg_duration FROM s""")
def agg_analytics_summary(t) -> DataFrame:
    s = t.events.groupBy("user_id").agg(count_where(F.col("event_type") == "view").alias("views"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("secs"))
    return s.agg(F.count("*").alias("sessions"), F.sum("views").alias("views"), F.round(F.avg("secs"), 4).alias("avg_duration"))


@query("""SELECT user_id AS job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_events,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS status,
  arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY 1""")
def agg_job_telemetry(t) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("job_id")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.count("*").alias("n_events"),
        job_status(F.bool_or(kind == "purchase"), F.bool_or(kind == "error")).alias("status"),
        F.max_by("value", F.when(kind == "error", F.col("event_id"))).alias("last_error"),
    )


@query("""SELECT count(*) FILTER (WHERE event_type = 'purchase') AS resolved, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS total, count(DISTINCT user_id % 10) AS n_chapters, count(*) FILTER (WHERE value > 100) AS anomalies FROM events""")
def agg_stream_stats(t) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    return t.events.agg(
        count_where(bought).alias("resolved"),
        F.round(F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0.0)), 4).alias("total"),
        F.countDistinct(F.col("user_id") % 10).alias("n_chapters"),
        count_where(F.col("value") > 100).alias("anomalies"),
    )


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def agg_event_counter(t) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("""SELECT count(*) FILTER (WHERE c_acctbal > 5000) AS profiled, count(*) FILTER (WHERE c_acctbal > 0 AND c_acctbal <= 5000) AS verified, count(*) FILTER (WHERE c_acctbal <= 0) AS unverified FROM customer""")
def agg_lead_status(t) -> DataFrame:
    """Mutually exclusive: profiled before verified before unverified."""
    v = F.col("c_acctbal")
    return t.customer.agg(count_where(v > 5000).alias("profiled"), count_where((v > 0) & (v <= 5000)).alias("verified"), count_where(v <= 0).alias("unverified"))


@query("""SELECT round(sum(l_quantity / 1e6 * 0.071 + l_extendedprice / 1e6 * 0.28), 6) AS cost, CAST(sum(l_linenumber) AS BIGINT) AS tokens FROM lineitem""")
def agg_tokens_cost(t) -> DataFrame:
    cost = F.col("l_quantity") / 1e6 * 0.071 + F.col("l_extendedprice") / 1e6 * 0.28
    return t.lineitem.agg(F.round(F.sum(cost), 6).alias("cost"), F.sum("l_linenumber").alias("tokens"))


@query("""WITH l AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' 07001' WHEN 2 THEN '07' || c_nationkey ELSE '28001' END AS cp,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'bathroom' WHEN 'HOUSEHOLD' THEN 'integral' WHEN 'MACHINERY' THEN 'pool' WHEN 'AUTOMOBILE' THEN 'other' END AS kind,
    CASE WHEN c_acctbal <= 0 THEN NULL ELSE CAST(c_acctbal AS INT) % 40 END AS size, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_name WHEN 2 THEN c_name || ' pide reforma' ELSE c_name || ' pide una reforma integral de la casa' END AS words,
    c_custkey % 6 = 0 AS disposable, c_custkey % 9 = 0 AS suspicious, c_custkey % 5 = 1 AS images, c_acctbal > 5000 AS budget, c_custkey % 7 < 3 AS timeline FROM customer),
r AS (SELECT c_custkey, CASE WHEN cp IS NULL THEN 'geo.postal_code_missing' WHEN trim(cp) LIKE '07%' THEN 'geo.in_service_area' ELSE 'geo.out_of_service_area' END AS r1,
    CASE WHEN kind IN ('bathroom', 'integral', 'pool') THEN 'scope.accepted_project_type' ELSE 'scope.rejected_project_type' END AS r2,
    CASE WHEN coalesce(size, 0) = 0 THEN 'size.unknown' WHEN size < CASE kind WHEN 'bathroom' THEN 3 WHEN 'integral' THEN 25 WHEN 'pool' THEN 8 WHEN 'other' THEN 0 END THEN 'size.below_minimum' ELSE 'size.adequate' END AS r3,
    CASE WHEN coalesce(length(trim(words)), 0) < 10 THEN 'content.description_too_short' WHEN length(trim(words)) < 30 THEN 'content.description_minimal' ELSE 'content.description_ok' END AS r4,
    CASE WHEN disposable THEN 'email.disposable' ELSE 'email.ok' END AS r5, CASE WHEN suspicious THEN 'security.injection_attempt' ELSE 'security.clean' END AS r6,
    CASE WHEN images THEN 10 ELSE 0 END + CASE WHEN budget THEN 5 ELSE 0 END + CASE WHEN timeline THEN 5 ELSE 0 END AS shown FROM l),
s AS (SELECT *, greatest(0, least(100, 50 + CASE r1 WHEN 'geo.postal_code_missing' THEN -10 WHEN 'geo.in_service_area' THEN 10 ELSE -25 END + CASE r2 WHEN 'scope.accepted_project_type' THEN 5 ELSE -20 END
    + CASE r3 WHEN 'size.unknown' THEN -5 WHEN 'size.below_minimum' THEN -15 ELSE 5 END + CASE r4 WHEN 'content.description_too_short' THEN -20 WHEN 'content.description_minimal' THEN -5 ELSE 5 END
    + CASE r5 WHEN 'email.ok' THEN 5 ELSE -25 END + CASE r6 WHEN 'security.clean' THEN 0 ELSE -30 END + shown)) AS score FROM r)
SELECT c_custkey, CASE WHEN score >= 70 THEN 'qualified' WHEN score >= 40 THEN 'review_required' ELSE 'rejected' END AS decision, score, concat_ws(' ', r1, r2, r3, r4, r5, r6, 'evidence.signals') AS rules,
  concat_ws(' ', CASE WHEN r1 <> 'geo.in_service_area' THEN r1 END, CASE WHEN r2 LIKE '%rejected%' THEN r2 END, CASE WHEN r3 <> 'size.adequate' THEN r3 END, CASE WHEN r4 <> 'content.description_ok' THEN r4 END,
    CASE WHEN r5 <> 'email.ok' THEN r5 END, CASE WHEN r6 <> 'security.clean' THEN r6 END, CASE WHEN shown = 0 THEN 'evidence.signals' END) AS failed, r5 <> 'email.ok' OR r6 <> 'security.clean' AS low_trust FROM s""")
def lead_score_rules(t) -> DataFrame:
    """Seven rules with their outcomes, the score clamped to 0 and 100, and two thresholds."""
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    lead = {
        "postal_code": F.when(F.col("c_nationkey") % 5 == 1, " 07001").when(F.col("c_nationkey") % 5 == 2, F.concat(F.lit("07"), F.col("c_nationkey"))).when(F.col("c_nationkey") % 5 > 2, "28001"),
        "project_type": F.when(F.col("c_mktsegment") == "BUILDING", "bathroom").when(F.col("c_mktsegment") == "HOUSEHOLD", "integral").when(F.col("c_mktsegment") == "MACHINERY", "pool").when(F.col("c_mktsegment") == "AUTOMOBILE", "other"),
        "square_metres": F.when(v > 0, F.rint(v).cast("int") % 40),
        "description": F.when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, F.concat("c_name", F.lit(" pide reforma"))).when(k % 4 == 3, F.concat("c_name", F.lit(" pide una reforma integral de la casa"))),
        "email": F.when(k % 6 == 0, "ana@Mailinator.com").otherwise("ana@obra.es"),
        "suspicious": F.when(k % 9 == 0, F.lit(True)),
        "images": F.when(k % 5 == 1, 2),
        "budget": F.when(v > 5000, v),
        "timeline": F.when(k % 7 < 3, "pronto"),
    }
    q = t.customer.select("c_custkey", qualify_lead(lead).alias("q"))
    return q.select("c_custkey", "q.decision", "q.score", F.array_join("q.rules", " ").alias("rules"), F.array_join("q.failed", " ").alias("failed"), "q.low_trust")


@query("""WITH u AS (SELECT user_id, min(ts) AS started, max(ts) AS updated FROM events GROUP BY 1)
SELECT user_id, CASE WHEN date_diff('second', started, TIMESTAMP '2024-01-31') > 90 * 60 THEN 'timed_out' WHEN date_diff('second', updated, TIMESTAMP '2024-01-31') > 300 THEN 'stale' ELSE 'running' END AS state FROM u""")
def job_ui_state(t) -> DataFrame:
    now = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp"))
    age = lambda c: now - F.unix_timestamp(c)
    u = t.events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("updated"))
    return u.select("user_id", F.when(age("started") > 90 * 60, "timed_out").when(age("updated") > 300, "stale").otherwise("running").alias("state"))


@query("""SELECT c_custkey, strftime(CAST(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) + o AS DATE), '%Y-%m-%d') AS due FROM customer, (VALUES (2), (5), (10)) v(o) WHERE c_acctbal > 9000""")
def schedule_offsets(t) -> DataFrame:
    """Three follow-ups for each qualified lead."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int"))
    offsets = t.customer.where("c_acctbal > 9000").select("c_custkey", start.alias("d"), F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))).alias("o"))
    return offsets.select("c_custkey", F.date_format(F.date_add("d", F.col("o")), "yyyy-MM-dd").alias("due"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def enrollment_dedupe(t) -> DataFrame:
    active = t.orders.where("o_orderstatus = 'O'")
    return t.customer.where("c_nationkey = 5").join(active, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, count(*) AS cancelled, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' GROUP BY 1")
def cancel_all_for_lead(t) -> DataFrame:
    """Pending rows marked as cancelled in a written table, and how many each lead had.

    Prices are added up in order of the orders' keys: a sum that is half a unit exactly is rounded by its last bit, which
    depends on the order of its addends.
    """
    path, out = scratch_path(t.spark, "schedule"), scratch_path(t.spark, "cancelled")
    t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderstatus").alias("status")).write.parquet(path)
    sinks.update_where(t.spark, path, out, (F.col("status") == "P") & (F.col("o_orderpriority") != "1-URGENT"), status=F.lit("cancelled"))
    cancelled = t.spark.read.parquet(out).where("status = 'cancelled'")
    upto = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = cancelled.select("o_custkey", F.sum("o_totalprice").over(upto).alias("total"), F.row_number().over(upto).alias("n"))
    return place.groupBy("o_custkey").agg(F.count("*").alias("cancelled"), F.round(F.max_by("total", "n")).cast("bigint").alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey")
def bookings_for_lead(t) -> DataFrame:
    open_ = t.orders.where((F.col("o_custkey") == 7) & (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")))
    return open_.orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT conv_id, turn, role = 'user' OR turn < 2 AS is_read FROM conversations")
def sink_mark_read(t) -> DataFrame:
    """Turns of a written table marked as read, the others left as they were."""
    path, out = scratch_path(t.spark, "turns"), scratch_path(t.spark, "read")
    t.conversations.select("conv_id", "turn", "role", (F.col("turn") < 2).alias("is_read")).write.parquet(path)
    sinks.update_where(t.spark, path, out, F.col("role") == "user", is_read=F.lit(True))
    return t.spark.read.parquet(out).select("conv_id", "turn", "is_read")
