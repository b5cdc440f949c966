"""Scans, filters, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.workloads.base import VIEWS, query


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_collection(t) -> DataFrame:
    return t.nation


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def scan_by_id(t) -> DataFrame:
    return t.customer.where("c_custkey = 77").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 3")
def scan_eq_filter(t) -> DataFrame:
    return t.customer.where("c_mktsegment = 'MACHINERY' AND c_nationkey = 3").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7','Brand#8','Brand#9','Brand#10')")
def scan_in_filter(t) -> DataFrame:
    """A list of wanted values, of which the first ten count."""
    wanted = [f"Brand#{i}" for i in range(1, 14)]
    return t.part.where(F.col("p_brand").isin(wanted[:10])).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-03-31'")
def scan_range(t) -> DataFrame:
    day = F.col("o_orderdate")
    return t.orders.where(day.between(F.lit("1997-01-01").cast("timestamp"), F.lit("1997-03-31").cast("timestamp"))).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def scan_prefix(t) -> DataFrame:
    return t.part.where(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 42")
def scan_nested_field(t) -> DataFrame:
    """A predicate on a field inside a document."""
    nested = t.events.select("event_id", F.from_json("props", "k long").alias("props"))
    return nested.where("props.k = 42").select("event_id", F.col("props.k").alias("k"))


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
def scan_null_eq(t) -> DataFrame:
    lines = t.lineitem.select("l_orderkey").distinct()
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").where(F.col("l_orderkey").isNull()).select("o_orderkey")


@query("SELECT vec_id, label FROM embeddings")
def scan_projection(t) -> DataFrame:
    """Only the columns asked for: the vectors are not read."""
    return t.embeddings.select("vec_id", "label")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def scan_count(t) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS parent, l_linenumber AS child, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def scan_parent_children(t) -> DataFrame:
    parents = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    children = t.lineitem.join(parents, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return children.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), "l_partkey")


@query("SELECT turn, role FROM conversations WHERE conv_id = 1 ORDER BY turn")
def scan_subcollection_ordered(t) -> DataFrame:
    return t.conversations.where("conv_id = 1").orderBy("turn").select("turn", "role")


@query(VIEWS + "SELECT project_id, line_no, round(total, 6) AS total FROM expenses WHERE status = 'validada'")
def filter_validated(t) -> DataFrame:
    return t.expenses.where("status = 'validada'").select("project_id", "line_no", F.round("total", 6).alias("total"))


@query("""SELECT c_custkey FROM customer WHERE coalesce(c_mktsegment, 'demo') IN ('MACHINERY', 'HOUSEHOLD') AND c_acctbal > 0
  AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), '7')""")
def filter_multi_lead(t) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    segment = F.coalesce("c_mktsegment", F.lit("demo"))
    return t.customer.where(segment.isin("MACHINERY", "HOUSEHOLD") & (F.col("c_acctbal") > 0) & text.contains("7")).select("c_custkey")


@query(VIEWS + "SELECT project_id, status FROM projects WHERE status IN ('preparacion', 'ejecucion')")
def filter_active_project(t) -> DataFrame:
    return t.projects.where(F.col("status").isin("preparacion", "ejecucion")).select("project_id", "status")


@query("SELECT event_id, hour(ts) AS hour FROM events WHERE isodow(ts) <= 5 AND hour(ts) < 14 AND event_type = 'signup' ORDER BY ts, event_id LIMIT 25")
def filter_slot(t) -> DataFrame:
    """First weekday mornings that are free."""
    free = t.events.where((F.weekday("ts") < 5) & (F.hour("ts") < 14) & (F.col("event_type") == "signup"))
    return free.orderBy("ts", "event_id").limit(25).select("event_id", F.hour("ts").alias("hour"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderstatus NOT IN ('F') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def filter_due(t) -> DataFrame:
    """Due rows that are neither sent nor cancelled; the limit comes last, so it never under-returns."""
    due = t.orders.where((F.col("o_orderdate") <= F.lit("1996-06-01").cast("timestamp")) & (F.col("o_orderstatus") != "F"))
    return due.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE coalesce(nullif(p_type, 'PROMO'), 'PARTIDA') = 'PARTIDA'")
def filter_partida_type(t) -> DataFrame:
    return t.part.where(F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("PARTIDA")) == "PARTIDA").select("p_partkey")


@query("SELECT c_custkey, concat_ws(', ', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS contact, coalesce(c_mktsegment, '') AS source FROM customer")
def project_lead_row(t) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.concat_ws(", ", F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("contact"), F.coalesce("c_mktsegment", F.lit("")).alias("source")
    )


@query("SELECT p_partkey, coalesce(nullif(p_retailprice, 0), CAST(p_size AS DOUBLE)) AS unit_price, coalesce(p_name, p_brand, '') AS description FROM part")
def project_v005_adapter(t) -> DataFrame:
    """Newer field, else the older one; 0 counts as missing."""
    price = F.coalesce(F.nullif("p_retailprice", F.lit(0.0)), F.col("p_size").cast("double"))
    return t.part.select("p_partkey", price.alias("unit_price"), F.coalesce("p_name", "p_brand", F.lit("")).alias("description"))


@query("SELECT p_partkey, p_type || ' > ' || p_brand || ' | ' || CAST(p_size AS VARCHAR) || ' | ' || p_name AS embedding_text FROM part")
def project_embedding_text(t) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_type", F.lit(" > "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | "), "p_name").alias("embedding_text"))


@query("""SELECT l_orderkey, p_min || '. Contiene: ' || parts AS chunk FROM (SELECT l_orderkey, min(p_name) AS p_min,
  string_agg(p_name || CASE WHEN l_returnflag = 'R' THEN ' (variable)' ELSE ' (fijo)' END, ', ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""")
def project_semantic_chunk(t) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    piece = F.struct("l_linenumber", "l_partkey", "l_returnflag", "p_name")
    items = rows.groupBy("l_orderkey").agg(F.min("p_name").alias("first"), F.sort_array(F.collect_list(piece)).alias("items"))
    named = F.transform("items", lambda x: F.concat(x["p_name"], F.when(x["l_returnflag"] == "R", " (variable)").otherwise(" (fijo)")))
    return items.select("l_orderkey", F.concat("first", F.lit(". Contiene: "), F.array_join(named, ", ")).alias("chunk"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 140 THEN substring(s, 1, 139) || '…' ELSE s END AS preview FROM x""")
def project_preview(t) -> DataFrame:
    s = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return t.documents.select("doc_id", F.when(F.char_length(s) > 140, F.concat(F.substring(s, 1, 139), F.lit("…"))).otherwise(s).alias("preview"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'searching' WHEN 'signup' THEN 'calculating' WHEN 'purchase' THEN 'complete' END AS phase FROM events""")
def project_event_phase(t) -> DataFrame:
    phase = {"view": "extracting", "click": "searching", "signup": "calculating", "purchase": "complete"}
    table = F.create_map(*(F.lit(x) for kv in phase.items() for x in kv))
    return t.events.select("event_id", F.try_element_at(table, "event_type").alias("phase"))


@query("""SELECT 'NL-' || l_orderkey || '-' || l_linenumber AS code, p_name || CASE WHEN l_returnflag = 'R' THEN ' [MATERIAL EXPLÍCITO: ' || p_brand || ']' ELSE '' END AS description,
  CASE WHEN l_quantity = 0 THEN 1.0 ELSE l_quantity END AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey""")
def project_task_to_item(t) -> DataFrame:
    material = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" [MATERIAL EXPLÍCITO: "), "p_brand", F.lit("]"))).otherwise("")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("NL-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("code"),
        F.concat("p_name", material).alias("description"),
        F.coalesce(F.nullif("l_quantity", F.lit(0.0)), F.lit(1.0)).alias("quantity"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.09 THEN 'discount' WHEN l_quantity < 5 THEN 'quantity' END AS error FROM lineitem""")
def row_validation_split(t) -> DataFrame:
    """Every row with the reason why it is invalid, null for the valid ones."""
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.09, "discount").when(F.col("l_quantity") < 5, "quantity").alias("error"))


@query("""SELECT l_orderkey, l_linenumber, abs(round(l_quantity * (p_retailprice + 0.0), 2) - round(l_extendedprice, 2)) < 0.02 AS is_valid FROM lineitem JOIN part ON p_partkey = l_partkey""")
def math_validate_line(t) -> DataFrame:
    gap = F.abs(F.round(F.col("l_quantity") * F.col("p_retailprice"), 2) - F.round("l_extendedprice", 2))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", (gap < 0.02).alias("is_valid"))


@query("""SELECT o_orderkey, round(coalesce(sum(l_extendedprice), 0), 2) AS computed, abs(round(coalesce(sum(l_extendedprice), 0), 2) - round(o_totalprice, 2)) < 0.02 AS is_valid
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def math_validate_chapter(t) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    x = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return x.select("o_orderkey", F.round("s", 2).alias("computed"), (F.abs(F.round("s", 2) - F.round("o_totalprice", 2)) < 0.02).alias("is_valid"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name ASC")
def sort_multi_dir(t) -> DataFrame:
    return t.supplier.orderBy(F.desc("s_acctbal"), F.asc("s_name")).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 40")
def limit_n(t) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), "event_id").limit(40).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topk_after_score(t) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def page_offset(t) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey > 10) ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def page_offset_cursor(t) -> DataFrame:
    """The page after a cursor: a filter that reaches the scan instead of a skip over earlier rows."""
    after = (F.col("c_acctbal") < 5000) | ((F.col("c_acctbal") == 5000) & (F.col("c_custkey") > 10))
    return t.customer.where(after).orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY 1, 2")
def sort_composite_key(t) -> DataFrame:
    return t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).orderBy("p_type", "p_brand")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def sort_keep_stable(t) -> DataFrame:
    """Ties keep the order of insertion: the key stands in for it."""
    return t.orders.orderBy("o_orderpriority", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("""WITH u AS (SELECT p_partkey AS id, p_name AS name, 1 AS prio FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand, 2 FROM part WHERE p_size > 10)
SELECT id, arg_min(name, prio) AS name FROM u GROUP BY id""")
def set_union_dedup_first(t) -> DataFrame:
    new = t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(1).alias("prio"))
    old = t.part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.lit(2).alias("prio"))
    return new.unionByName(old).groupBy("id").agg(F.min_by("name", "prio").alias("name"))


@query("""WITH a AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS moment FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10),
b AS (SELECT 'ship' AS kind, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS moment FROM lineitem ORDER BY l_shipdate DESC, id LIMIT 10),
c AS (SELECT 'event' AS kind, event_id AS id, ts AS moment FROM events ORDER BY ts DESC, event_id LIMIT 5)
SELECT kind, id FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY moment DESC, kind, id LIMIT 10""")
def set_union_activity(t) -> DataFrame:
    """Three feeds, each cut to its newest rows, merged."""
    newest = lambda df, kind, id_, at, n: df.select(F.lit(kind).alias("kind"), id_.alias("id"), F.col(at).alias("at")).orderBy(F.desc("at"), "id").limit(n)
    a = newest(t.orders, "order", F.col("o_orderkey"), "o_orderdate", 10)
    b = newest(t.lineitem, "ship", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate", 10)
    c = newest(t.events, "event", F.col("event_id"), "ts", 5)
    return a.unionByName(b).unionByName(c).orderBy(F.desc("at"), "kind", "id").limit(10).select("kind", "id")


@query("""WITH u AS (SELECT l_partkey AS id, l_extendedprice AS score FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_partkey, l_extendedprice FROM lineitem WHERE l_discount > 0.08)
SELECT id, max(score) AS score FROM u GROUP BY id""")
def set_dedup_candidates(t) -> DataFrame:
    pick = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"))
    both = pick("l_quantity > 40").unionByName(pick("l_discount > 0.08"))
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "score")


@query("""SELECT l_orderkey, list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))) AS flags FROM lineitem GROUP BY 1""")
def set_merge_distinct_array(t) -> DataFrame:
    both = F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus"))
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(both).alias("flags"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select(F.col("s_nationkey").alias("nation")))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(t) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("nation")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("""WITH k AS (SELECT p_partkey, string_split(p_name, ' ') AS topics FROM part)
SELECT p_partkey, len(topics) = 0 OR list_has_any(topics, ['red', 'small', 'ring']) AS passes FROM k""")
def set_topics_overlap(t) -> DataFrame:
    topics = F.split("p_name", " ")
    wanted = F.array(*map(F.lit, ("red", "small", "ring")))
    return t.part.select("p_partkey", ((F.size(topics) == 0) | F.arrays_overlap(topics, wanted)).alias("passes"))


@query("SELECT DISTINCT p_type AS chapter FROM part")
def set_distinct_values(t) -> DataFrame:
    return t.part.select(F.col("p_type").alias("chapter")).distinct()
