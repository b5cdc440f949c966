"""Window functions and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.aggregate import positions
from gneiss.operators.joins import first_by
from gneiss.operators.ordered import clamped_score, grouped_runs, islands
from gneiss.workloads.base import query


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def win_topn_rank(t) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("n", F.row_number().over(order)).where("n <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win_latest_per_key(t) -> DataFrame:
    return first_by(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def win_latest_file(t) -> DataFrame:
    """Latest by date, then version, then kind."""
    return first_by(t.part, ["p_brand"], F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").select("p_brand", "p_partkey")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def win_forward_fill(t) -> DataFrame:
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(upto).alias("carried"))


@query("""SELECT p_partkey, coalesce(first_value(CASE WHEN length(p_name) > 9 THEN p_name END IGNORE NULLS) OVER w, first_value(p_name) OVER w) AS canonical
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_canonical_chapter(t) -> DataFrame:
    all_ = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    long = F.when(F.length("p_name") > 9, F.col("p_name"))
    return t.part.select("p_partkey", F.coalesce(F.first(long, ignorenulls=True).over(all_), F.first("p_name").over(all_)).alias("canonical"))



@query("""SELECT event_id, date_diff('second', ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts)) AS block FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""")
def win_next_match_block(t) -> DataFrame:
    """Each match up to the next one."""
    e = t.events.select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts"))
    nxt = F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts"))
    return e.select("event_id", (F.unix_timestamp(nxt) - F.unix_timestamp("ts")).alias("block"))


@query("""WITH r AS (SELECT *, CASE WHEN NOT easy OR NOT coalesce(lag(easy) OVER w, FALSE) OR coalesce(lag(event_type) OVER w, '') <> event_type THEN 1 ELSE 0 END AS b
  FROM (SELECT event_id, user_id, event_type, value < 40 AS easy FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1) // 5 AS part FROM n)
SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, run, part ORDER BY event_id) AS group_id FROM p""")
def win_islands_grouping(t) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", (F.col("value") < 40).alias("easy"))
    return grouped_runs(rows, ["user_id"], "event_id", "easy", "event_type").select("event_id", "group_id")


@query("""SELECT user_id, item, count(*) AS n_lines, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS item FROM events) WHERE item > 0 GROUP BY 1, 2""")
def win_regex_islands(t) -> DataFrame:
    """Lines belong to the last item that started."""
    rows = islands(t.events, ["user_id"], ["event_id"], F.col("event_type") == "signup", "item").where("item > 0")
    return rows.groupBy("user_id", "item").agg(F.count("*").alias("n_lines"), F.sum("event_id").alias("ids"))


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS open, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, min(closed) OVER (PARTITION BY user_id, open ORDER BY event_id) AS at_start FROM s WHERE open > 0)
SELECT user_id, open AS item, round(sum(value), 4) AS total, bool_or(event_type = 'purchase') AS is_closed FROM f WHERE closed = at_start GROUP BY 1, 2""")
def win_parser_state(t) -> DataFrame:
    """From an opening line to the line that closes it; what follows belongs to none."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = islands(t.events, ["user_id"], ["event_id"], F.col("event_type") == "signup", "open")
    s = s.withColumn("closed", F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(before), F.lit(0))).where("open > 0")
    s = s.withColumn("at_start", F.min("closed").over(Window.partitionBy("user_id", "open").orderBy("event_id")))
    return s.where("closed = at_start").groupBy("user_id", F.col("open").alias("item")).agg(
        F.round(F.sum("value"), 4).alias("total"), F.bool_or(F.col("event_type") == "purchase").alias("is_closed")
    )


@query("SELECT p_type AS chapter, min(p_partkey) AS first_seen, rank() OVER (ORDER BY min(p_partkey)) AS chapter_order FROM part GROUP BY 1")
def win_row_order(t) -> DataFrame:
    """Chapters in the order in which they first appear."""
    firsts = t.part.groupBy(F.col("p_type").alias("chapter")).agg(F.min("p_partkey").alias("first_seen"))
    return positions(firsts, "first_seen").select("chapter", "first_seen", (F.col("position") + 1).alias("chapter_order"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 30.0 WHEN 'error' THEN -45.0 ELSE value / 10 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, n, greatest(0.0, least(100.0, 50.0 + delta)) AS score FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, greatest(0.0, least(100.0, f.score + e.delta)) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, round(arg_max(score, n), 4) AS score FROM f GROUP BY 1""")
def win_score_history(t) -> DataFrame:
    """A score clamped at every step."""
    delta = F.when(F.col("event_type") == "purchase", 30.0).when(F.col("event_type") == "error", -45.0).otherwise(F.col("value") / 10)
    rows = t.events.select("user_id", "event_id", F.col("event_id").alias("at"), delta.alias("delta"))
    return clamped_score(rows, ["user_id"], "at", "event_id", "delta", 50.0).select("user_id", F.round("score", 4).alias("score"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NULL OR p <> o_orderstatus")
def win_stage_history(t) -> DataFrame:
    """Only rows where the stage changes."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.withColumn("p", before).where("p IS NULL OR p <> o_orderstatus").select("o_orderkey", "o_custkey")


@query("SELECT user_id, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS seconds FROM events GROUP BY 1")
def win_stream_duration(t) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))


@query("""WITH n AS (SELECT conv_id, turn, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CAST(coalesce(sum(l) FILTER (WHERE i < n // 3), 0) AS BIGINT) AS front, CAST(coalesce(sum(l) FILTER (WHERE i >= n - n // 3), 0) AS BIGINT) AS back FROM n GROUP BY 1""")
def win_page_thirds(t) -> DataFrame:
    """First third of the pages against the last third."""
    by = Window.partitionBy("conv_id")
    n = t.conversations.select("conv_id", F.length("text").alias("l"), (F.row_number().over(by.orderBy("turn")) - 1).alias("i"), F.floor(F.count("*").over(by) / 3).alias("third"), F.count("*").over(by).alias("n"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("l"))), F.lit(0)).cast("bigint")
    return n.groupBy("conv_id").agg(part(F.col("i") < F.col("third")).alias("front"), part(F.col("i") >= F.col("n") - F.col("third")).alias("back"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE a <= 3 OR b <= 3")
def win_first_last_pages(t) -> DataFrame:
    by = Window.partitionBy("conv_id")
    ends = t.conversations.withColumn("a", F.row_number().over(by.orderBy("turn"))).withColumn("b", F.row_number().over(by.orderBy(F.desc("turn"))))
    return ends.where("a <= 3 OR b <= 3").select("conv_id", "turn")


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 1 ELSE max(p_retailprice) OVER () - min(p_retailprice) OVER () END, 6) AS scaled FROM part")
def minmax_scale(t) -> DataFrame:
    ends = t.part.agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    span = F.coalesce(F.nullif(F.col("b") - F.col("a"), F.lit(0.0)), F.lit(1.0))
    return t.part.crossJoin(F.broadcast(ends)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("a")) / span, 6).alias("scaled"))
