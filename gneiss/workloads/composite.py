"""Sources and sinks read back, matching, layout and whole pipelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import budget, units
from gneiss.operators import matching, ordered
from gneiss.operators.aggregate import count_where
from gneiss.operators.index import VectorIndex
from gneiss.plans import dag, layout, pricing, retrieval
from gneiss.sources import sinks
from gneiss.sources.scratch import scratch_path, stored
from gneiss.workloads.base import VIEWS, query
from gneiss.workloads.pricing import budgets


@query("SELECT n_nationkey, n_name FROM nation")
def scan_json_file(t) -> DataFrame:
    """Written as JSON lines, read with a schema."""
    path = scratch_path(t.spark, "json")
    sinks.write_json(t.nation.select("n_nationkey", "n_name"), path)
    return t.spark.read.schema("n_nationkey int, n_name string").json(path)


@query("SELECT r_regionkey, r_name FROM region")
def sink_json(t) -> DataFrame:
    path = scratch_path(t.spark, "json")
    sinks.write_json(t.region, path)
    return t.spark.read.schema("r_regionkey int, r_name string").json(path)


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier")
def sink_csv(t) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t.supplier.select("s_suppkey", "s_name"), path)
    return t.spark.read.schema("s_suppkey bigint, s_name string").option("sep", ";").option("header", True).csv(path)


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def sink_batched_write(t) -> DataFrame:
    path = scratch_path(t.spark, "batches")
    sinks.batched_write(t.customer, path, 100)
    return t.spark.read.parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n, max(CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END) AS last FROM nation GROUP BY 1")
def sink_replace_children(t) -> DataFrame:
    """Children of one parent replaced, the others left."""
    path = scratch_path(t.spark, "children")
    sinks.replace_children(t.nation, path, "n_regionkey")
    new = t.nation.where("n_regionkey = 2").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    sinks.replace_children(new, path, "n_regionkey")
    back = t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(path)
    return back.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_name").alias("last"))


@query("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'MACHINERY')")
def sink_wipe(t) -> DataFrame:
    """A conditional delete as a copy without the rows."""
    path, out = scratch_path(t.spark, "full"), scratch_path(t.spark, "rest")
    t.customer.select("c_custkey", "c_mktsegment").write.parquet(path)
    sinks.delete_where(t.spark, path, out, F.col("c_mktsegment") == "MACHINERY")
    return t.spark.read.parquet(out).select("c_custkey")


@query("SELECT conv_id, turn, turn >= n / 2.0 AS is_summatory FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def scan_pdf_images(t) -> DataFrame:
    """Which pages are in the second half."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return t.conversations.select("conv_id", "turn", (F.col("turn") >= n / 2.0).alias("is_summatory"))




def _sides(t) -> tuple[DataFrame, DataFrame]:
    """Parts of even and odd keys, as the two sides of a match within each budget (brand); codes are written in several ways."""
    k, size = F.col("p_partkey"), F.col("p_size")
    number = (size % 6 + 1).cast("string")
    chapter = F.when(k % 4 < 2, F.concat(F.lit("C0"), number)).otherwise(number)
    code = F.when(k % 10 < 4, F.concat(chapter, F.when(k % 3 == 0, "-").otherwise("."), F.floor(k / 2) % 5 + 1)).otherwise(F.concat(F.lit("P"), k))
    text = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), F.substring(F.md5((size % 10).cast("string")), 1, 12))
    rows = t.part.select(
        F.col("p_brand").alias("block"), k.alias("seq"), code.alias("code"), F.when(k % 40 > 1, text).alias("description"),
        F.col("p_type").alias("chapter"), F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * size).alias("total"),
    )
    return rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")


@query()
def join_cascade_match(t) -> DataFrame:
    """One-to-one cascade over whole budgets: exact code, normal code, description."""
    return matching.cascade_match(*_sides(t), "block")


@query()
def join_cascade_full(t) -> DataFrame:
    """Both sides of whole budgets, with what is missing or extra: by zero-padded code, then by description."""
    return matching.full_outer_match(*_sides(t), "block")


@query()
def pipe_eval_report(t) -> DataFrame:
    """All metrics of one side beside the other, and the thresholds that they are held to."""
    return matching.eval_report(*_sides(t), "block", {"recall_min": 0.2, "precision_semantic_min": 0.5, "price_delta_p50_max": 0.5, "chapter_total_delta_weighted_max": 0.3})


CODED = r"""WITH g AS (SELECT p_type AS block, p_partkey AS g, p_brand || '-' || p_size AS code FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT p_type AS block, p_partkey AS f, p_brand || CASE WHEN p_size % 2 = 0 THEN '.' ELSE '-' END || p_size AS code FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT g, f FROM (SELECT *, row_number() OVER (PARTITION BY block, code ORDER BY g) AS n FROM g) JOIN (SELECT *, row_number() OVER (PARTITION BY block, code ORDER BY f) AS n FROM f) USING (block, code, n)),
g2 AS (SELECT block, g, lower(regexp_replace(code, '[^A-Za-z0-9_]', '', 'g')) AS code FROM g WHERE g NOT IN (SELECT g FROM e)),
f2 AS (SELECT block, f, lower(regexp_replace(code, '[^A-Za-z0-9_]', '', 'g')) AS code FROM f WHERE f NOT IN (SELECT f FROM e)),
m AS (SELECT g, f FROM (SELECT *, row_number() OVER (PARTITION BY block, code ORDER BY g) AS n FROM g2) JOIN (SELECT *, row_number() OVER (PARTITION BY block, code ORDER BY f) AS n FROM f2) USING (block, code, n)),
c AS (SELECT (SELECT count(*) FROM e) AS exact, (SELECT count(*) FROM m) AS normal, (SELECT count(*) FROM g) AS golden) """


def _coded(t) -> tuple[DataFrame, DataFrame]:
    """Matches by code of the parts with even keys and those with odd ones, whose codes are written another way; and the golden side."""
    side = lambda odd, mark: t.part.where(F.col("p_partkey") % 2 == odd).select(
        F.col("p_type").alias("block"), F.col("p_partkey").alias("seq"), F.concat("p_brand", mark, F.col("p_size").cast("string")).alias("code"), F.col("p_name").alias("description")
    )
    golden = side(0, F.lit("-"))
    return matching.code_matches(golden, side(1, F.when(F.col("p_size") % 2 == 0, ".").otherwise("-")), "block")[0], golden


@query(CODED + "SELECT round(CASE WHEN golden = 0 THEN 0 ELSE (exact + normal) / golden END, 6) AS recall FROM c")
def agg_recall(t) -> DataFrame:
    """Share of golden rows that have a match, 0 on nothing."""
    matches, golden = _coded(t)
    n = golden.agg(F.count("*").alias("n"))
    found = matches.agg(F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(found)).select(F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0), 6).alias("recall"))


@query(CODED + "SELECT round(CASE WHEN exact + normal = 0 THEN 0 ELSE exact / (exact + normal) END, 6) AS precision FROM c")
def agg_precision(t) -> DataFrame:
    """Share of matches by exact code, 0 on nothing."""
    share = F.avg(F.when(F.col("level") == "exact_code", 1.0).otherwise(0.0))
    return _coded(t)[0].agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("precision"))


@query()
def agg_semantic(t) -> DataFrame:
    """Share of neighbouring benchmark items that are alike."""
    b = t.benchmark.select("item_id", "text")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    alike = matching.fuzzy_ratio(F.col("text"), F.col("other")) >= 0.3
    return pairs.select(alike.alias("a")).agg(F.coalesce(F.avg(F.col("a").cast("int")), F.lit(0.0)).alias("share"))


@query()
def fuzzy_ratio(t) -> DataFrame:
    return t.part.select("p_partkey", matching.fuzzy_ratio(F.col("p_name"), F.concat("p_name", F.lit(" "), "p_brand")).alias("ratio"))


@query()
def hybrid_similarity(t) -> DataFrame:
    return t.part.select("p_partkey", matching.hybrid_similarity(F.col("p_name"), F.concat("p_brand", F.lit(" "), "p_name")).alias("similarity"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
  coalesce(CASE turn % 3 WHEN 0 THEN trim('C0' || (turn % 5) || ' ' || substring(text, 1, 6)) WHEN 1 THEN 'NOT FOUND' END, '') AS name FROM conversations),
k AS (SELECT *, name IN ('', 'NOT FOUND') OR contains(name, '[') AS none FROM c),
r AS (SELECT conv_id, turn, n, CASE WHEN none THEN '' ELSE name END AS chapter FROM k WHERE n = 1
  UNION ALL SELECT k.conv_id, k.turn, k.n, CASE WHEN k.none THEN r.chapter WHEN r.chapter = '' THEN k.name
    WHEN left(k.name, 3) = left(r.chapter, 3) AND length(k.name) <= length(r.chapter) + 3 THEN r.chapter ELSE k.name END
  FROM r JOIN k ON k.conv_id = r.conv_id AND k.n = r.n + 1)
SELECT conv_id, turn, chapter FROM r""")
def win_forward_fill_chapter(t) -> DataFrame:
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("C0"), (F.col("turn") % 5).cast("string"), F.lit(" "), F.substring("text", 1, 6))).when(F.col("turn") % 3 == 1, "NOT FOUND")
    return ordered.forward_fill_chapter(t.conversations.select("conv_id", "turn", name.alias("chapter")), ["conv_id"], "turn")


@query("""SELECT conv_id, first(name ORDER BY length(name) > 5 DESC, turn) AS chapter, count(*) AS n FROM
  (SELECT conv_id, turn, coalesce(trim('C0' || (turn % 3) || ' ' || substring(text, 1, CAST(turn % 7 AS INTEGER))), '') AS name FROM conversations) WHERE name <> '' GROUP BY conv_id, left(name, 3)""")
def stabilize_chapter_name(t) -> DataFrame:
    """One name for each chapter of a document, by the code that it begins with."""
    name = F.coalesce(F.concat(F.lit("C0"), (F.col("turn") % 3).cast("string"), F.lit(" "), F.substring(F.col("text"), F.lit(1), (F.col("turn") % 7).cast("int"))), F.lit(""))
    stable = ordered.canonical_chapters(t.conversations.select("conv_id", "turn", name.alias("chapter")).where("chapter <> ''"), ["conv_id"], "turn")
    return stable.groupBy("conv_id", "chapter").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE q AS (SELECT l_suppkey, l_orderkey AS block, first(floor(l_quantity / 10) ORDER BY l_linenumber, floor(l_quantity / 10)) AS first_q, sum(floor(l_quantity / 10)) AS whole FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY block) AS n FROM q),
r AS (SELECT l_suppkey, block, n, whole AS q, CASE WHEN whole > 0 THEN whole ELSE 0 END AS total FROM b WHERE n = 1
  UNION ALL SELECT l_suppkey, block, n, own, CASE WHEN own > 0 THEN own ELSE total END FROM
    (SELECT b.l_suppkey, b.block, b.n, r.total, CASE WHEN r.total > 0 AND abs(b.first_q - r.total) < 0.01 THEN b.whole - b.first_q ELSE b.whole END AS own FROM r JOIN b ON b.l_suppkey = r.l_suppkey AND b.n = r.n + 1))
SELECT l_suppkey, block, q FROM r""")
def win_carry_over_discard(t) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("at"), F.floor(F.col("l_quantity") / 10).cast("double").alias("q"))
    return ordered.drop_carry_over(rows, ["l_suppkey"], "block", "at", "q")


@query("SELECT o_orderkey AS node, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS level FROM orders")
def sort_topological(t) -> DataFrame:
    """Levels of the graph in which each order needs the two before it of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = t.orders.select(F.col("o_orderkey").alias("node"), F.array(F.lag("o_orderkey", 1).over(w), F.lag("o_orderkey", 2).over(w)).alias("before"))
    needs = before.select("node", F.explode("before").alias("needs"))
    return dag.topological_levels(t.orders.select(F.col("o_orderkey").alias("node")), needs.where("needs IS NOT NULL"))


#: What chapters need, and those that go along with all others.
WORKS = {"DEMOLICIONES": (), "TIERRAS": ("DEMOLICIONES",), "HORMIGONES": ("TIERRAS",), "REVOCOS": ("HORMIGONES", "DEMOLICIONES"), "PINTURA": ("REVOCOS",), "SEGURIDAD": ("DEMOLICIONES",)}
ALONG = ("SEGURIDAD",)


@query("""WITH RECURSIVE g(chapter, needs) AS (VALUES ('DEMOLICIONES', []::VARCHAR[]), ('TIERRAS', ['DEMOLICIONES']), ('HORMIGONES', ['TIERRAS']), ('REVOCOS', ['HORMIGONES', 'DEMOLICIONES']), ('PINTURA', ['REVOCOS'])),
c AS (SELECT l_orderkey AS doc, list_extract(['PINTURA', 'HORMIGONES', 'SEGURIDAD', 'DEMOLICIONES', 'OTROS', 'TIERRAS', 'REVOCOS'], CAST(l_partkey % 7 AS INT) + 1) AS chapter, max(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2),
k AS (SELECT c.*, list_filter(g.needs, lambda n: list_contains(a.own, n)) AS needs FROM c JOIN g USING (chapter) JOIN (SELECT doc, list(chapter) AS own FROM c GROUP BY 1) a USING (doc)),
r AS (SELECT DISTINCT doc, []::VARCHAR[] AS done, CAST(NULL AS VARCHAR) AS chapter, 0 AS n FROM k
  UNION ALL SELECT doc, list_append(done, chapter), chapter, n + 1 FROM
    (SELECT r.doc, r.done, k.chapter, r.n, row_number() OVER (PARTITION BY r.doc ORDER BY k.seq, k.chapter) AS first FROM r JOIN k ON k.doc = r.doc WHERE NOT list_contains(r.done, k.chapter) AND list_has_all(r.done, k.needs)) WHERE first = 1),
p AS (SELECT doc, chapter, 0 AS kind, n AS place FROM r WHERE n > 0 UNION ALL SELECT doc, chapter, CASE chapter WHEN 'SEGURIDAD' THEN 1 ELSE 2 END, seq FROM c WHERE chapter IN ('SEGURIDAD', 'OTROS'))
SELECT doc AS o_orderkey, chapter, CAST(row_number() OVER (PARTITION BY doc ORDER BY kind, place) - 1 AS INT) AS position FROM p""")
def sort_planned_order(t) -> DataFrame:
    """Chapters of each order as the work goes: what is needed first, then what goes along, then what is unknown."""
    names = F.array(*map(F.lit, ("PINTURA", "HORMIGONES", "SEGURIDAD", "DEMOLICIONES", "OTROS", "TIERRAS", "REVOCOS")))
    c = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("seq"), F.get(names, (F.col("l_partkey") % 7).cast("int")).alias("chapter"))
    out = dag.planned_orders(c.withColumnRenamed("l_orderkey", "o_orderkey"), WORKS, ALONG, "o_orderkey")
    return out.select("o_orderkey", "chapter", "position")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'superficie' WHEN 1 THEN 'masa' END AS dimension FROM part")
def unit_dimension(t) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("M2", " tn ", "zz"))), (F.col("p_partkey") % 3).cast("int") + 1)
    return t.part.select("p_partkey", units.unit_dimension(raw).alias("dimension"))


@query("SELECT p_partkey, p_partkey % 3 = 1 AS same FROM part")
def same_dimension(t) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("M2", " tn ", "zz"))), (F.col("p_partkey") % 3).cast("int") + 1)
    return t.part.select("p_partkey", units.same_dimension(raw, F.lit("kg")).alias("same"))


@query("SELECT o_orderkey, greatest(1, CAST(ceil(date_diff('millisecond', o_orderdate, TIMESTAMP '1999-01-01') / 86400000.0) AS BIGINT)) AS days FROM orders")
def days_elapsed(t) -> DataFrame:
    ms = F.unix_millis(F.lit("1999-01-01").cast("timestamp")) - F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", F.greatest(F.lit(1), F.ceil(ms / 86_400_000)).alias("days"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE o_totalprice / 100 * 365 END AS projected FROM orders")
def projected_cost(t) -> DataFrame:
    """Burn rate over the whole term, or the cost so far where there is no end."""
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", price).otherwise(price / 100 * 365).alias("projected"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 100.0 / c_acctbal ELSE 0 END AS pct FROM customer")
def pct_or_zero(t) -> DataFrame:
    v = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(v > 0, F.lit(100.0) / v).otherwise(0.0).alias("pct"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN 0.9 + l_discount * 3 > 1.05 THEN 'ahead' WHEN 0.9 + l_discount * 3 < 0.95 THEN 'behind' ELSE 'on_track' END AS band FROM lineitem")
def status_band(t) -> DataFrame:
    x = 0.9 + F.col("l_discount") * 3
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(x > 1.05, "ahead").when(x < 0.95, "behind").otherwise("on_track").alias("band"))


@query(VIEWS + "SELECT p.project_id, round(CASE WHEN p.status = 'completado' THEN p.estimate ELSE coalesce(sum(e.total), 0) END, 4) AS cost FROM projects p LEFT JOIN expenses e USING (project_id) GROUP BY p.project_id, p.status, p.estimate")
def effective_real_cost(t) -> DataFrame:
    """The stored cost where there is one, else the sum of expenses."""
    spent = t.expenses.groupBy("project_id").agg(F.sum("total").alias("s"))
    stored = F.when(F.col("status") == "completado", F.col("estimate"))
    return t.projects.join(spent, "project_id", "left").select("project_id", F.round(F.coalesce(stored, "s", F.lit(0.0)), 4).alias("cost"))


@query("SELECT p_partkey, k AS hint, CASE k WHEN 'kg' THEN p_size * 1000.0 WHEN 't' THEN CAST(p_size AS DOUBLE) END AS converted FROM part, (VALUES ('kg'), ('t'), ('m2')) v(k)")
def tool_context(t) -> DataFrame:
    """Each hint of a map converted to its unit."""
    hints = t.part.select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, ("kg", "t", "m2")))).alias("hint"))
    none = F.create_map().cast("map<string,double>")
    return hints.select("p_partkey", "hint", units.unit_convert(F.col("p_size").cast("double"), F.lit("t"), F.col("hint"), none).alias("converted"))


@query("SELECT l_orderkey, round(sum(l_extendedprice) * 1.25, 6) AS total FROM lineitem GROUP BY 1")
def apply_markup(t) -> DataFrame:
    """Components marked up and summed."""
    factor = budget.markup_factor(F.lit(10.0), F.lit(15.0))
    return budgets(t).select("l_orderkey", F.round(budget.total_of(F.col("parts")) * factor, 6).alias("total"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice * 1.2502 ELSE o_totalprice * 1.25 END, 6) AS price FROM orders")
def rebake(t) -> DataFrame:
    """Marked up anew only where the factor changes by a ten-thousandth or more."""
    old = budget.markup_factor(F.lit(10.0), F.lit(15.0))
    new = old + F.when(F.col("o_orderkey") % 3 == 2, 0.0002).when(F.col("o_orderkey") % 3 == 1, 0.0001).otherwise(0.0)
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(budget.rebake(price, price * old, old, new), 6).alias("price"))


@query("SELECT n_nationkey, CAST(540 + 75 * i AS BIGINT) AS minute FROM nation, (SELECT unnest(generate_series(0, 20)) AS i) WHERE 540 + 75 * i + 60 <= 540 + (n_nationkey % 5 + 1) * 120")
def slots_for_day(t) -> DataFrame:
    """Slots of 60 minutes with a buffer of 15 inside a range."""
    end = (540 + (F.col("n_nationkey") % 5 + 1) * 120).cast("bigint")
    starts = t.nation.select("n_nationkey", end.alias("e")).select("n_nationkey", "e", F.explode(F.expr("sequence(540L, e, 75L)")).alias("minute"))
    return starts.where(F.col("minute") + 60 <= F.col("e")).select("n_nationkey", "minute")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS half_up, CAST(floor(-l_quantity / 2 + 0.5) AS BIGINT) AS toward_plus FROM lineitem")
def rounding(t) -> DataFrame:
    """Half up toward plus infinity."""
    up = lambda x: F.floor(x + 0.5)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", up(F.col("l_extendedprice")).alias("half_up"), up(-F.col("l_quantity") / 2).alias("toward_plus"))


@query("SELECT doc_id, substring(text, 1, 200) AS head, right(text, 200) AS tail FROM documents")
def doc_role_sampling(t) -> DataFrame:
    """First and last characters of a document: the feature is the sample."""
    return t.documents.select("doc_id", F.substring("text", 1, 200).alias("head"), F.right("text", F.lit(200)).alias("tail"))


def _pages(t) -> DataFrame:
    """Order lines written as pages of a budget, a page for each line number."""
    unit = F.element_at(F.array(*map(F.lit, ("m2", "Ud", "ml"))), (F.col("l_partkey") % 3).cast("int") + 1)
    line = F.concat(F.lit("C"), (F.col("l_suppkey") % 9).cast("string"), F.lit("."), F.col("l_partkey").cast("string"), F.lit(" Partida "), unit, F.lit(" LÍNEA "), F.col("l_returnflag"), F.lit("\nDescripción de la línea\n"), F.translate(F.format_string("%.2f", "l_quantity"), ".", ","))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.struct("l_partkey", line.alias("x")).alias("s"))
    return rows.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "\n").alias("text"))


PAGES = """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no,
  length('C' || (l_suppkey % 9) || '.' || l_partkey || ' Partida ' || CASE l_partkey % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'Ud' ELSE 'ml' END || ' LÍNEA ' || l_returnflag
    || chr(10) || 'Descripción de la línea' || chr(10) || format('{:.2f}', l_quantity)) AS n, l_quantity FROM lineitem),
p AS (SELECT doc_id, page_no, sum(n + 1) AS n, count(*) AS items FROM l GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) AS n_pages, sum(n) AS n_chars, CAST(sum(items) AS BIGINT) AS n_items FROM p GROUP BY 1) """


@query(PAGES + """SELECT doc_id, CASE WHEN n_chars - 1 < 200 OR n_items < 3 THEN 'UNKNOWN' ELSE 'INLINE_WITH_TITLES' END AS layout,
  CAST(CASE WHEN n_chars - 1 < 200 THEN 1.0 WHEN n_items < 3 THEN 0.6 WHEN n_items >= 20 THEN 0.9 ELSE 0.65 END AS DOUBLE) AS confidence, n_items FROM d""")
def layout_classify(t) -> DataFrame:
    """Items and their quantities stand on the same pages here, so no document is annexed."""
    return layout.classify(_pages(t)).withColumn("n_items", F.col("n_items").cast("bigint"))





@query()
def pipe_fragment_retrieval(t) -> DataFrame:
    """Correction fragments for the parts whose key is divisible by 50, against all parts as fragments."""
    at = F.lit("2025-12-01").cast("timestamp")
    code = F.concat(F.lpad((F.col("p_size") % 7).cast("string"), 2, "0"), F.lit("."), F.col("p_partkey").cast("string"))
    lines = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("line_id"), code.alias("code"), F.concat("p_type", F.lit(" "), "p_brand").alias("chapter"), F.col("p_name").alias("description"), F.array(F.lower("p_type")).alias("topics"))
    tag = F.when(F.col("p_partkey") % 997 == 0, "cross_chapter:true").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("chapter_code:"), (F.col("p_size") % 7).cast("string"))).otherwise(F.concat(F.lit("chapter:"), "p_brand"))
    f = t.part.select(F.col("p_partkey").alias("fragment_id"), F.lit("golden").alias("status"), F.array(tag, F.lower("p_type")).alias("tags"), F.col("p_name").alias("description"), at.alias("at"), (F.col("p_size") > 40).alias("is_baseline"))
    return retrieval.retrieve_fragments(lines, f, "2026-01-01")


@query("""SELECT p_partkey AS item_id, p_type || ' > ' || p_brand || ' | ' || p_name AS embedding_text, list_transform(generate_series(0, 3), lambda i: CASE WHEN i = 0 THEN CAST(length(p_type || ' > ' || p_brand || ' | ' || p_name) AS DOUBLE) ELSE 0.0 END) AS embedding FROM part WHERE p_retailprice > 0""")
def pipe_catalog_reindex(t) -> DataFrame:
    """Valid items with their text and a vector that depends on it alone, written in batches and read back."""
    s = F.concat("p_type", F.lit(" > "), "p_brand", F.lit(" | "), "p_name")
    path = scratch_path(t.spark, "index")
    items = t.part.where("p_retailprice > 0").select(F.col("p_partkey").alias("item_id"), s.alias("embedding_text"), F.array(F.length(s).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("embedding"))
    sinks.batched_write(items, path, 500)
    return t.spark.read.schema(items.schema).parquet(path)


PRICED = """WITH cat AS (SELECT vec_id AS item_id, embedding, 'c' || (vec_id % 97) AS code, ['k' || label] AS words, label % 3 AS dimension, CASE label % 2 WHEN 0 THEN 'm²' ELSE 'ud' END AS unit, CAST(10 + vec_id % 50 AS DOUBLE) AS price FROM embeddings),
lin AS (SELECT vec_id AS line_id, vec_id // 50 % 4 AS budget_id, vec_id AS seq, CASE WHEN label % 5 > 0 THEN 'ch' || (label % 2) END AS chapter, CASE WHEN label = 3 THEN 'Medios auxiliares de obra' WHEN label <> 4 THEN 'Solado' END AS description, embedding, ['k' || (label % 4), 'k9'] AS keywords,
  label % 3 AS dimension, 'm2' AS unit, CASE WHEN label <> 6 THEN 1.0 + label * CASE WHEN label = 7 THEN 1e4 ELSE 1.0 END END AS quantity FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT l.*, c.item_id, c.code, c.words, c.dimension AS cd, c.unit AS cu, c.price, list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS cosine FROM lin l, cat c),
near AS (SELECT *, cosine * (1 + 0.5 * len(list_intersect(keywords, words)) / 2.0) * CASE WHEN dimension <> cd THEN 0.3 ELSE 1.0 END AS score FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY cosine DESC, item_id) AS r FROM n) WHERE r <= 45),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id, code ORDER BY score DESC, item_id) AS k FROM near) WHERE k = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, item_id) AS rank FROM once) """


def _priced_tables(t) -> tuple[DataFrame, DataFrame]:
    """Vectors whose id is divisible by 50 as budget lines, and all vectors as a catalog."""
    word = lambda c: F.concat(F.lit("k"), c.cast("string"))
    label, key = F.col("label"), F.col("vec_id")
    catalog = t.embeddings.select(
        key.alias("item_id"), "embedding", F.concat(F.lit("c"), (key % 97).cast("string")).alias("code"), F.array(word(label)).alias("words"), (label % 3).alias("dimension"),
        F.when(label % 2 == 0, "m²").otherwise("ud").alias("unit"), (10.0 + key % 50).alias("price"),
    )
    lines = t.embeddings.where("vec_id % 50 = 0").select(
        key.alias("line_id"), (F.floor(key / 50) % 4).alias("budget_id"), key.alias("seq"), F.when(label % 5 > 0, F.concat(F.lit("ch"), (label % 2).cast("string"))).alias("chapter"),
        F.when(label == 3, "Medios auxiliares de obra").when(label != 4, "Solado").alias("description"), "embedding", F.array(word(label % 4), F.lit("k9")).alias("keywords"),
        (label % 3).alias("dimension"), F.lit("m2").alias("unit"), F.when(label != 6, 1.0 + label * F.when(label == 7, 1e4).otherwise(1.0)).alias("quantity"),
    )
    return lines, catalog


@query(PRICED + """, sel AS (SELECT line_id, list(item_id ORDER BY rank DESC) AS ids FROM top WHERE rank IN (2, 4) AND line_id % 200 = 0 GROUP BY 1),
ranked AS (SELECT t.*, CASE WHEN list_position(ids, item_id) > 0 THEN list_position(ids, item_id) END AS place FROM top t LEFT JOIN sel USING (line_id) WHERE rank <= 15),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY place NULLS LAST, rank) AS f FROM ranked) WHERE f = 1),
v AS (SELECT vec_id AS line_id, CASE WHEN label % 4 = 1 THEN 'from_scratch' ELSE '1:1' END AS kind, label = 5 AS review, 20.0 + label AS flash, CASE WHEN label <> 9 THEN 30.0 + label END AS pro, label % 8 < 7 AS valued FROM embeddings WHERE vec_id % 50 = 0),
b0 AS (SELECT f.*, coalesce(chapter, 'Sin Capítulo') AS ch, coalesce(quantity, 0) AS qty, coalesce(description LIKE 'Medios%', FALSE) AS anc, CASE WHEN score >= 0.85 AND cu = 'm²' THEN 'flash' ELSE 'pro' END AS tier, v.kind, v.review, v.flash, v.pro, v.valued
  FROM firsts f JOIN v USING (line_id) WHERE line_id % 350 <> 0),
best AS (SELECT *, tier = 'flash' AND valued AND pro IS NOT NULL AND (kind = 'from_scratch' OR review) AS escalated FROM b0),
runs AS (SELECT *, CASE WHEN tier = 'flash' AND lag(tier) OVER w = 'flash' AND lag(ch) OVER w = ch THEN 0 ELSE 1 END AS b FROM best WINDOW w AS (PARTITION BY budget_id ORDER BY seq)),
nr AS (SELECT *, sum(b) OVER (PARTITION BY budget_id ORDER BY seq) AS run FROM runs), pl AS (SELECT *, (row_number() OVER (PARTITION BY budget_id, run ORDER BY seq) - 1) // 5 AS part FROM nr),
w1 AS (SELECT *, first_value(seq) OVER (PARTITION BY budget_id, run, part ORDER BY seq) AS group_id, CASE WHEN NOT valued THEN price WHEN tier = 'pro' OR escalated THEN coalesce(pro, price) ELSE flash END AS p1,
  CASE WHEN valued AND (CASE WHEN tier = 'pro' OR escalated THEN pro IS NOT NULL ELSE TRUE END) THEN CASE WHEN tier = 'pro' OR escalated THEN 'pro-' || kind ELSE kind END ELSE '1:1' END AS match_kind,
  valued AND tier = 'flash' AND NOT escalated AND review AS asked FROM pl),
w2 AS (SELECT *, CASE WHEN anc THEN 0.02 * coalesce(sum(CASE WHEN NOT anc THEN qty * p1 END) OVER (PARTITION BY budget_id, ch), 0) ELSE p1 END AS unit_price FROM w1)
SELECT line_id, budget_id, item_id, tier, escalated, match_kind, group_id, round(unit_price, 6) AS unit_price, round(CASE WHEN anc THEN unit_price ELSE qty * p1 END, 6) AS total, asked OR unit_price * qty > 100000 AS needs_review,
  CAST(CASE WHEN asked OR unit_price * qty > 100000 THEN 40 ELSE 95 END AS INT) AS confidence FROM w2
UNION ALL SELECT line_id, budget_id, -1, 'pro', FALSE, 'resumed', -1, 1.5, 3.0, FALSE, 95 FROM lin WHERE line_id % 350 = 0""")
def pipe_pricing(t) -> DataFrame:
    """Lines priced from a catalog: some of an earlier run, some reranked, valued in two tiers, ancillary ones last."""
    lines, catalog = _priced_tables(t)
    label = F.col("label")
    done = lines.where("line_id % 350 = 0").select(
        "line_id", "budget_id", F.lit(-1).cast("bigint").alias("item_id"), F.lit("pro").alias("tier"), F.lit(False).alias("escalated"), F.lit("resumed").alias("match_kind"), F.lit(-1).cast("bigint").alias("group_id"),
        F.lit(1.5).alias("unit_price"), F.lit(3.0).alias("total"), F.lit(False).alias("needs_review"), F.lit(95).alias("confidence"),
    )
    found = stored(pricing.candidates(lines, catalog), "candidates")
    chosen = F.sort_array(F.collect_list(F.struct(F.col("rank"), "item_id")), asc=False)
    selected = found.where("rank IN (2, 4) AND line_id % 200 = 0").groupBy("line_id").agg(F.concat(F.array(F.lit(-5).cast("bigint")), F.transform(chosen, lambda x: x["item_id"])).alias("ids"))
    kind = F.when(label % 4 == 1, "from_scratch").otherwise("1:1")
    quick = F.struct(F.lit("flash").alias("tier"), kind.alias("match_kind"), (label == 5).alias("needs_review"), (20.0 + label).alias("unit_price"))
    slow = F.struct(F.lit("pro").alias("tier"), F.concat(F.lit("pro-"), kind).alias("match_kind"), F.lit(None).cast("boolean").alias("needs_review"), (30.0 + label).alias("unit_price"))
    both = t.embeddings.where("vec_id % 50 = 0 AND label % 8 < 7").select(F.col("vec_id").alias("line_id"), "label", F.explode(F.array(quick, slow)).alias("v"))
    valuations = both.where("label <> 9 OR v.tier = 'flash'").select("line_id", "v.*")
    p = pricing.price_lines(lines, catalog, valuations, selected, done, found)
    return p.withColumn("unit_price", F.round("unit_price", 6)).withColumn("total", F.round("total", 6))


@query()
def join_knn_index(t) -> DataFrame:
    """The ten vectors most like each query (ids divisible by 50), from an index that looks into some of its lists."""
    index = VectorIndex.fit(t.embeddings)
    rows = stored(index.indexed(t.embeddings.select("vec_id", "embedding")), "index")
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.nearest(queries, rows, 10, "query_id", "vec_id", probes=max(8, len(index.centres) // 2)).withColumn("score", F.round("score", 6))


@query(PRICED + "SELECT line_id, item_id, rank, round(score, 6) AS score FROM top WHERE rank <= 15")
def pipe_catalog_candidates(t) -> DataFrame:
    """The fifteen candidates of each line of ``pipe_pricing``, one for each code."""
    c = pricing.candidates(*_priced_tables(t))
    return c.withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS doc_id, 'C' || (l_suppkey % 9) AS chapter, l_partkey, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
r AS (SELECT doc_id, n, chapter, l_partkey, q AS own, q AS total FROM b WHERE n = 1
  UNION ALL SELECT doc_id, n, chapter, l_partkey, own, CASE WHEN own > 0 THEN own ELSE total END FROM
    (SELECT b.doc_id, b.n, b.chapter, b.l_partkey, r.total, CASE WHEN abs(b.q - r.total) < 0.01 THEN 0.0 ELSE b.q END AS own FROM r JOIN b ON b.doc_id = r.doc_id AND b.n = r.n + 1))
SELECT doc_id, count(DISTINCT chapter) AS n_chapters, count(*) FILTER (WHERE p_partkey IS NULL) AS n_unpriced, round(coalesce(sum(own * p_retailprice), 0) * 1.25, 6) AS subtotal, round(coalesce(sum(own * p_retailprice), 0) * 1.25 * 1.21, 6) AS total
FROM r LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 GROUP BY 1""")
def pipe_pdf_budget(t) -> DataFrame:
    """Items read from pages, priced from a catalog by their code, marked up, and each document's totals with tax."""
    items = layout.extract_items(_pages(t), described=False).select("doc_id", F.substring_index("code", ".", 1).alias("chapter"), F.substring_index("code", ".", -1).cast("bigint").alias("item"), "quantity")
    catalog = t.part.where("p_size > 5").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"))
    amount = F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0)) * budget.markup_factor(F.lit(10.0), F.lit(15.0))
    priced = items.join(catalog, "item", "left").groupBy("doc_id")
    return priced.agg(F.countDistinct("chapter").alias("n_chapters"), count_where(F.col("price").isNull()).alias("n_unpriced"), F.round(amount, 6).alias("subtotal"), F.round(amount * 1.21, 6).alias("total"))


@query("""WITH x AS (SELECT l_orderkey AS budget_id, l_linenumber * 1000000 + l_partkey AS seq, CASE l_partkey % 4 WHEN 0 THEN 'VARIOS' WHEN 1 THEN 'OBRA' WHEN 2 THEN 'VARIOS' ELSE 'PINTURA' END AS name,
  5 * coalesce(floor(p_retailprice), 0) * l_quantity AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'P' LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5),
c AS (SELECT budget_id, name, min(seq) AS first, count(*) AS n, sum(total) AS total, row_number() OVER (PARTITION BY budget_id ORDER BY min(seq)) AS place FROM x GROUP BY 1, 2)
SELECT budget_id, string_agg(place || ' ' || name || ' ' || n, '; ' ORDER BY place) AS chapters, sum(total) / 1.25 AS execution, round(sum(total) / 1.25 * 0.1, 2) AS overhead, round(sum(total) / 1.25 * 0.15, 2) AS benefit,
  round(sum(total) * 0.21, 2) AS tax, round(sum(total) * 1.21, 2) AS total FROM c GROUP BY 1""")
def pipe_nl_budget(t) -> DataFrame:
    """Tasks of pending orders, priced by a catalog where it has them, in chapters as they come, marked up, with all sums."""
    chapter = F.get(F.array(F.lit("  "), F.lit("OBRA"), F.lit(None), F.lit(" PINTURA")), (F.col("l_partkey") % 4).cast("int"))
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("budget_id"))
    catalog = t.part.where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), (F.floor("p_retailprice") * 4.0).alias("unit_price"))
    tasks = t.lineitem.join(pending, F.col("l_orderkey") == F.col("budget_id")).join(catalog, "l_partkey", "left")
    tasks = tasks.select("budget_id", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), chapter.alias("chapter"), "unit_price", F.col("l_quantity").alias("quantity"))
    out = pricing.finished_budgets(tasks)
    return out.withColumn("chapters", F.array_join(F.transform("chapters", lambda c: F.concat_ws(" ", c["order"], c["name"], c["n_items"])), "; "))


@query("""SELECT string_agg(line, chr(10) ORDER BY i) AS report FROM (SELECT 0 AS i, '# Regiones' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' AS line
  UNION ALL SELECT 1 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)""")
def sink_markdown_report(t) -> DataFrame:
    """A report for people, written as text and read back."""
    path = scratch_path(t.spark, "report")
    report = sinks.markdown_report(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regiones")
    t.spark.createDataFrame([(report,)], "value string").coalesce(1).write.text(path)
    return t.spark.read.text(path, wholetext=True).select(F.rtrim("value", F.lit("\n")).alias("report"))
