"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.joins import cosine, first_by, nearest, pair_in_order
from gneiss.workloads.base import VIEWS, query


@query("""SELECT o_orderkey AS deal_id, o_orderstatus AS stage, o_totalprice AS value, c_name AS lead_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def join_deals_leads(t) -> DataFrame:
    leads = t.customer.where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("lead_name"))
    deals = t.orders.join(leads, F.col("o_custkey") == F.col("c_custkey"), "left")
    return deals.select(F.col("o_orderkey").alias("deal_id"), F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").alias("value"), "lead_name")


@query("""SELECT l_suppkey AS provider_id, list_sort(list(DISTINCT coalesce(p_brand, CAST(l_partkey AS VARCHAR)))) AS names FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1""")
def join_provider_project_names(t) -> DataFrame:
    named = t.lineitem.join(t.part.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left")
    name = F.coalesce("p_brand", F.col("l_partkey").cast("string"))
    return named.groupBy(F.col("l_suppkey").alias("provider_id")).agg(F.sort_array(F.collect_set(name)).alias("names"))


@query(VIEWS + """SELECT p.project_id, round(coalesce(sum(e.total), 0), 4) AS real_cost FROM projects p LEFT JOIN expenses e ON e.project_id = p.project_id AND e.status = 'validada' GROUP BY 1""")
def join_project_expense_agg(t) -> DataFrame:
    """Aggregated before the join, so a row a project moves."""
    cost = t.expenses.where("status = 'validada'").groupBy("project_id").agg(F.sum("total").alias("c"))
    return t.projects.join(cost, "project_id", "left").select("project_id", F.round(F.coalesce("c", F.lit(0.0)), 4).alias("real_cost"))


@query(VIEWS + """SELECT project_id, status FROM projects WHERE estimate > 0 AND project_id IN (SELECT project_id FROM expenses WHERE status = 'validada' GROUP BY 1 HAVING sum(total) > 0)""")
def semi_projects_with_cost(t) -> DataFrame:
    paid = t.expenses.where("status = 'validada'").groupBy("project_id").agg(F.sum("total").alias("c")).where("c > 0")
    return t.projects.where("estimate > 0").join(paid, "project_id", "left_semi").select("project_id", "status")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_budgets_without_project(t) -> DataFrame:
    started = t.orders.where("o_orderstatus = 'P'")
    return t.customer.join(started, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def anti_resume(t) -> DataFrame:
    """What is left to do: rows without a checkpoint."""
    done = t.orders.where("o_orderstatus = 'F'")
    return t.lineitem.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("""WITH m AS (SELECT max(l_orderkey) AS top FROM lineitem), s AS (SELECT unnest(generate_series(1, (SELECT top FROM m))) AS page)
SELECT page FROM s WHERE page NOT IN (SELECT l_orderkey FROM lineitem)""")
def anti_page_gaps(t) -> DataFrame:
    """Numbers up to the largest that do not occur."""
    top = t.lineitem.agg(F.max("l_orderkey")).first()[0] or 0
    pages = t.spark.range(1, top + 1).withColumnRenamed("id", "page")
    return pages.join(t.lineitem, F.col("page") == F.col("l_orderkey"), "left_anti")


@query("""WITH days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-07', INTERVAL 1 DAY)) AS d), slots AS (SELECT d, unnest([9, 10, 11, 12, 16, 17]) AS h FROM days),
taken AS (SELECT DISTINCT CAST(ts AS DATE) AS d, hour(ts) AS h FROM events WHERE event_type = 'purchase')
SELECT strftime(s.d, '%Y-%m-%d') AS day, CAST(s.h AS INTEGER) AS hour FROM slots s LEFT JOIN taken k ON CAST(s.d AS DATE) = k.d AND s.h = k.h WHERE k.d IS NULL""")
def anti_slots_bookings(t) -> DataFrame:
    """Slots of a week that no booking takes."""
    slots = t.spark.range(1).select(F.explode(F.expr("sequence(DATE '2024-01-01', DATE '2024-01-07')")).alias("d")).withColumn("hour", F.explode(F.array(*map(F.lit, (9, 10, 11, 12, 16, 17)))))
    taken = t.events.where("event_type = 'purchase'").select(F.to_date("ts").alias("d"), F.hour("ts").alias("hour")).distinct()
    return slots.join(taken, ["d", "hour"], "left_anti").select(F.date_format("d", "yyyy-MM-dd").alias("day"), "hour")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS taken FROM customer")
def exists_slot_taken(t) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("taken"))


@query("""WITH a AS (SELECT p_partkey, p_name FROM part WHERE p_size <= 25), b AS (SELECT lower(trim(p_brand)) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a.p_name, CAST(b.id AS VARCHAR), 'unassigned') AS phase FROM lineitem LEFT JOIN a ON a.p_partkey = l_partkey LEFT JOIN b ON b.name = lower('Brand#' || (l_suppkey % 40))""")
def join_phase_cost_two_key(t) -> DataFrame:
    """By id, else by name in lower case, else unassigned."""
    a = t.part.where("p_size <= 25").select("p_partkey", "p_name")
    b = t.part.groupBy(F.lower(F.trim("p_brand")).alias("name")).agg(F.min("p_partkey").alias("id"))
    key = F.lower(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 40).cast("string")))
    x = t.lineitem.withColumn("name", key).join(a, F.col("l_partkey") == F.col("p_partkey"), "left").join(b, "name", "left")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_name", F.col("id").cast("string"), F.lit("unassigned")).alias("phase"))


@query(r"""WITH d AS (SELECT regexp_replace(p_brand, '[^0-9]', '', 'g') AS code, arg_max(p_size, p_partkey) AS qty FROM part GROUP BY 1)
SELECT s_suppkey, coalesce(CAST(d.qty AS DOUBLE), 0.0) AS quantity FROM supplier LEFT JOIN d ON d.code = regexp_replace(s_name, '[^1-9]', '', 'g')""")
def join_desc_summatory(t) -> DataFrame:
    """Equi-join on the digits of a code; of duplicates the last counts, a missing one is 0."""
    digits = F.regexp_replace("p_brand", "[^0-9]", "")
    d = first_by(t.part.withColumn("code", digits), ["code"], F.desc("p_partkey")).select("code", F.col("p_size").cast("double").alias("qty"))
    s = t.supplier.withColumn("code", F.regexp_replace("s_name", "[^1-9]", ""))
    return s.join(d, "code", "left").select("s_suppkey", F.coalesce("qty", F.lit(0.0)).alias("quantity"))


@query("""WITH g AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size > 25),
p AS (SELECT p_partkey AS other, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size <= 25)
SELECT p_partkey AS golden, other AS found, 'code' AS level FROM g JOIN p USING (p_brand, n)""")
def join_cascade_code(t) -> DataFrame:
    """The equi-join steps of the one-to-one cascade; the fuzzy step is in ``gneiss.operators.matching``."""
    g = t.part.where("p_size > 25").select("p_brand", F.col("p_partkey").alias("golden"))
    p = t.part.where("p_size <= 25").select("p_brand", F.col("p_partkey").alias("found"))
    return pair_in_order(g, p, ["p_brand"], "golden", "found").select("golden", "found", F.lit("code").alias("level"))


@query("""WITH a AS (SELECT p_brand AS code, sum(p_retailprice) AS x FROM part WHERE p_size > 20 GROUP BY 1), b AS (SELECT p_brand AS code, sum(p_retailprice) AS y FROM part WHERE p_size <= 30 GROUP BY 1)
SELECT code, round(abs(x - y), 4) AS diff FROM a JOIN b USING (code) ORDER BY abs(x - y) DESC, code LIMIT 10""")
def join_variance_topk(t) -> DataFrame:
    a = t.part.where("p_size > 20").groupBy(F.col("p_brand").alias("code")).agg(F.sum("p_retailprice").alias("x"))
    b = t.part.where("p_size <= 30").groupBy(F.col("p_brand").alias("code")).agg(F.sum("p_retailprice").alias("y"))
    d = a.join(b, "code").select("code", F.abs(F.col("x") - F.col("y")).alias("d"))
    return d.orderBy(F.desc("d"), "code").limit(10).select("code", F.round("d", 4).alias("diff"))


TOTALS = """WITH a AS (SELECT p_type AS chapter, sum(p_retailprice) AS golden FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
b AS (SELECT p_type AS chapter, sum(p_retailprice) * 0.9 AS found FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1) """


def chapter_totals(t) -> tuple[DataFrame, DataFrame]:
    total = lambda df, alias, k: df.groupBy(F.col("p_type").alias("chapter")).agg((F.sum("p_retailprice") * k).alias(alias))
    return total(t.part.where("p_type <> 'PROMO'"), "golden", 1.0), total(t.part.where("p_type <> 'ECONOMY'"), "found", 0.9)


@query(TOTALS + "SELECT chapter, round(abs(golden - coalesce(found, 0)) / golden, 6) AS rel_delta FROM a LEFT JOIN b USING (chapter) WHERE golden > 0")
def join_chapter_totals_left(t) -> DataFrame:
    a, b = chapter_totals(t)
    gap = F.abs(F.col("golden") - F.coalesce("found", F.lit(0.0))) / F.col("golden")
    return a.where("golden > 0").join(b, "chapter", "left").select("chapter", F.round(gap, 6).alias("rel_delta"))


@query(TOTALS + "SELECT chapter, round(abs(coalesce(golden, 0) - coalesce(found, 0)), 4) AS error FROM a FULL JOIN b USING (chapter)")
def join_chapter_totals_full(t) -> DataFrame:
    a, b = chapter_totals(t)
    gap = F.abs(F.coalesce("golden", F.lit(0.0)) - F.coalesce("found", F.lit(0.0)))
    return a.join(b, "chapter", "full").select("chapter", F.round(gap, 4).alias("error"))


@query(TOTALS + "SELECT round(coalesce(sum(abs(coalesce(golden, 0) - coalesce(found, 0))) / nullif(sum(coalesce(golden, 0)), 0), 0), 6) AS weighted, round(coalesce(avg(abs(golden - coalesce(found, 0)) / golden) FILTER (WHERE golden > 0), 0), 6) AS mean FROM a FULL JOIN b USING (chapter)")
def agg_chapter_delta_weighted(t) -> DataFrame:
    """Weighted and mean relative error of chapter totals."""
    a, b = chapter_totals(t)
    g, f = F.coalesce("golden", F.lit(0.0)), F.coalesce("found", F.lit(0.0))
    whole = F.sum(g)
    return a.join(b, "chapter", "full").agg(
        F.round(F.coalesce(F.sum(F.abs(g - f)) / F.nullif(whole, F.lit(0.0)), F.lit(0.0)), 6).alias("weighted"),
        F.round(F.coalesce(F.avg(F.when(F.col("golden") > 0, F.abs(g - f) / F.col("golden"))), F.lit(0.0)), 6).alias("mean"),
    )


@query(TOTALS + "SELECT round(coalesce(avg(abs(golden - coalesce(found, 0)) / golden), 0), 6) AS mean, count(*) AS n_chapters FROM a LEFT JOIN b USING (chapter) WHERE golden > 0")
def agg_chapter_delta_mean(t) -> DataFrame:
    """Mean relative error of the totals of golden chapters."""
    a, b = chapter_totals(t)
    gap = F.abs(F.col("golden") - F.coalesce("found", F.lit(0.0))) / F.col("golden")
    return a.where("golden > 0").join(b, "chapter", "left").agg(F.round(F.coalesce(F.avg(gap), F.lit(0.0)), 6).alias("mean"), F.count("*").alias("n_chapters"))


@query("""WITH a AS (SELECT string_split(p_name, ' ')[1] AS prefix, count(*) AS n FROM part GROUP BY 1), b AS (SELECT string_split(p_name, ' ')[1] AS prefix, sum(p_size) AS size FROM part WHERE p_size > 45 GROUP BY 1)
SELECT prefix, n, coalesce(CAST(size AS BIGINT), 0) AS size FROM a LEFT JOIN b USING (prefix)""")
def join_chapter_prefix(t) -> DataFrame:
    named = t.part.withColumn("prefix", F.split("p_name", " ")[0])
    a = named.groupBy("prefix").agg(F.count("*").alias("n"))
    b = named.where("p_size > 45").groupBy("prefix").agg(F.sum("p_size").alias("size"))
    return a.join(b, "prefix", "left").select("prefix", "n", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


KNN = """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score, label FROM embeddings, q {where})
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _knn(t, rows: DataFrame) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(queries, rows, 10, "query_id", "vec_id").select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(KNN.format(where=""))
def join_knn(t) -> DataFrame:
    """Ten nearest vectors of every fiftieth, against all."""
    return _knn(t, t.embeddings)


@query(KNN.format(where="WHERE label IN (1, 2, 3)"))
def join_knn_filtered(t) -> DataFrame:
    return _knn(t, t.embeddings.where(F.col("label").isin(1, 2, 3)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN p_name END AS inherited FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def join_inherit_breakdown(t) -> DataFrame:
    """A lookup for some rows only."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", F.col("p_name")).alias("inherited"))


@query("SELECT n_regionkey AS node, list_sort(list(n_nationkey)) AS followers FROM nation GROUP BY 1")
def join_dag_followers(t) -> DataFrame:
    """Reverse adjacency of the edges nation -> region."""
    return t.nation.groupBy(F.col("n_regionkey").alias("node")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("followers"))


@query("""WITH present AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey), need(p_type, prereq) AS (VALUES ('PROMO', 'ECONOMY'), ('STANDARD', 'PROMO'), ('LARGE', 'SMALL'))
SELECT p.l_orderkey, p.p_type AS chapter, list_sort(list(n.prereq)) AS missing FROM present p JOIN need n ON n.p_type = p.p_type
LEFT JOIN present q ON q.l_orderkey = p.l_orderkey AND q.p_type = n.prereq WHERE q.p_type IS NULL GROUP BY 1, 2""")
def join_missing_prereq(t) -> DataFrame:
    """Chapters of an order whose prerequisites it lacks: one row an order holds all its chapters."""
    need = F.create_map(*(F.lit(x) for x in ("PROMO", "ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL")))
    have = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("have"))
    lacking = F.filter("have", lambda x: need[x].isNotNull() & ~F.array_contains("have", need[x]))
    return have.select("l_orderkey", F.explode(lacking).alias("chapter")).select("l_orderkey", "chapter", F.array(need[F.col("chapter")]).alias("missing"))


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def merge_provider_by_cif(t) -> DataFrame:
    """Insert the keys that are new."""
    have = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).join(have, "id", "left_anti")
    return have.unionByName(new)


@query("""SELECT 'a' AS source, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings
UNION ALL SELECT 'b', p_partkey, 0.0 FROM part""")
def join_catalog_two_sources(t) -> DataFrame:
    """All vectors scored against one, and a second source without vectors."""
    one = F.broadcast(t.embeddings.where("vec_id = 0").limit(1).select(F.col("embedding").alias("_q")))  # one row
    a = t.embeddings.crossJoin(one).select(F.lit("a").alias("source"), F.col("vec_id").alias("id"), F.round(cosine("_q", "embedding"), 6).alias("score"))
    return a.unionByName(t.part.select(F.lit("b").alias("source"), F.col("p_partkey").alias("id"), F.lit(0.0).alias("score")))


@query("SELECT vec_id, list_transform(embedding[1:16], lambda x: round(CAST(x AS DOUBLE), 6)) AS head FROM embeddings")
def truncate_vector(t) -> DataFrame:
    """The first sixteen dimensions of each vector, rounded; what is rounded to nothing keeps its sign."""
    short = lambda x: F.when((x < 0) & (F.round(x, 6) == 0), F.lit(-0.0)).otherwise(F.round(x, 6))
    return t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: short(x.cast("double"))).alias("head"))


@query(r"""SELECT regexp_replace(p_brand, '[^0-9]', '', 'g') AS code, arg_max(p_size, p_partkey) AS quantity FROM part GROUP BY 1""")
def last_write_wins(t) -> DataFrame:
    """A dictionary from rows in order: of equal keys the last value stays."""
    return t.part.groupBy(F.regexp_replace("p_brand", "[^0-9]", "").alias("code")).agg(F.max_by("p_size", "p_partkey").alias("quantity"))
