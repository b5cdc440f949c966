"""Budgets, components, catalog search and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import budget, files, rules
from gneiss.functions.text import first_named
from gneiss.operators.aggregate import count_where, percentiles, positions, sum_where
from gneiss.operators.joins import nearest
from gneiss.operators.matching import fuzzy_ratio, hybrid_similarity
from gneiss.plans.pricing import mode_total
from gneiss.workloads.base import query

#: Components of a budget: the lines of an order, coded by return flag.
PARTS_SQL = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'mo' WHEN 'A' THEN 'mt' ELSE 'xx' END || l_partkey AS code,
  l_linestatus = 'F' AS is_variable, l_extendedprice AS total FROM lineitem),
k AS (SELECT *, CASE WHEN code LIKE 'mo%' THEN 'labor' WHEN code LIKE 'mt%' AND is_variable THEN 'material_variable' WHEN code LIKE 'mt%' THEN 'material_fixed' ELSE 'machinery' END AS category FROM c) """


def components(t) -> DataFrame:
    code = F.concat(F.when(F.col("l_returnflag") == "R", "mo").when(F.col("l_returnflag") == "A", "mt").otherwise("xx"), F.col("l_partkey").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", code.alias("code"), F.lit("MACHINERY").alias("type"), (F.col("l_linestatus") == "F").alias("is_variable"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("yield_amount"),
    )


def budgets(t) -> DataFrame:
    """Orders with their components as an array."""
    part = F.struct("l_linenumber", "l_partkey", "code", "type", "is_variable", "price", "total", "yield_amount")
    return components(t).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(part)).alias("parts"))


@query(PARTS_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, category FROM k")
def categorize_component(t) -> DataFrame:
    return components(t).select("l_orderkey", "l_linenumber", "l_partkey", budget.categorize(F.col("code"), F.col("type"), F.col("is_variable")).alias("category"))


@query(PARTS_SQL + """SELECT l_orderkey, round(coalesce(sum(total) FILTER (WHERE category = 'labor'), 0), 2) AS labor_only,
  round(coalesce(sum(total) FILTER (WHERE category <> 'material_variable'), 0), 2) AS labor_and_fixed, round(sum(total), 2) AS complete FROM k GROUP BY 1""")
def agg_mode_price(t) -> DataFrame:
    """Price of an order by mode: what of its components each mode leaves out, in one aggregation."""
    return sums_by_category(t).select("l_orderkey", F.round("labor", 2).alias("labor_only"), F.round(F.col("complete") - F.col("variable"), 2).alias("labor_and_fixed"), F.round("complete", 2).alias("complete"))


def sums_by_category(t) -> DataFrame:
    """Totals of each order's components: labour, variable material, and all."""
    k = components(t).select("l_orderkey", "total", budget.categorize(F.col("code"), F.col("type"), F.col("is_variable")).alias("c"))
    return k.groupBy("l_orderkey").agg(
        sum_where("total", F.col("c") == "labor").alias("labor"), sum_where("total", F.col("c") == "material_variable").alias("variable"), F.sum("total").alias("complete")
    )


@query(PARTS_SQL + """, s AS (SELECT l_orderkey, sum(total) AS pem, sum(total) FILTER (WHERE category = 'labor') AS labor FROM k GROUP BY 1)
SELECT l_orderkey, round(pem, 2) AS pem, round(pem - coalesce(labor, 0), 2) AS deduction, round(pem * 1.25 * 1.1, 7) AS complete_total, round(coalesce(labor, 0) * 1.25 * 1.1, 7) AS execution_total FROM s""")
def agg_editor_breakdown(t) -> DataFrame:
    s = sums_by_category(t).withColumnRenamed("complete", "pem")
    return s.select(
        "l_orderkey", F.round("pem", 2).alias("pem"), F.round(F.col("pem") - F.col("labor"), 2).alias("deduction"),
        F.round(F.col("pem") * 1.25 * 1.1, 7).alias("complete_total"), F.round(F.col("labor") * 1.25 * 1.1, 7).alias("execution_total"),
    )


@query(PARTS_SQL + """SELECT l_orderkey, round(round(sum(total), 2) * 1.2, 2) AS unit_price, round(sum(total), 2) AS unit_price_raw, round(3 * round(round(sum(total), 2) * 1.2, 2), 2) AS total_price,
  round(sum(round(total * 1.2, 2)), 2) AS parts_total, round(sum(total), 2) AS parts_raw FROM k GROUP BY 1""")
def bake_markup(t) -> DataFrame:
    """A budget line and its components marked up, the raw values beside them."""
    factor = budget.markup_factor(F.lit(10.0), F.lit(10.0))
    b = budgets(t).select("l_orderkey", budget.bake_markup(F.round(budget.total_of(F.col("parts")), 2), F.lit(3.0), F.col("parts"), factor).alias("b"))
    total = lambda name: F.round(F.aggregate(F.col("b.parts"), F.lit(0.0), lambda s, p: s + p[name]), 2)
    return b.select("l_orderkey", "b.unit_price", "b.unit_price_raw", "b.total_price", total("total").alias("parts_total"), total("raw_total").alias("parts_raw"))


@query("SELECT o_orderkey, round(1.25 / (1.0 + (o_orderkey % 5) * 5 / 100.0), 6) AS shown FROM orders")
def markup_factor_display(t) -> DataFrame:
    baked = budget.markup_factor((F.col("o_orderkey") % 5) * 5.0, F.lit(0.0))
    return t.orders.select("o_orderkey", F.round(1.25 / baked, 6).alias("shown"))


@query(PARTS_SQL + """, s AS (SELECT l_orderkey, sum(total) AS total FROM k GROUP BY 1), u AS (SELECT l_orderkey, total, total * (1 + (l_orderkey % 9 - 4) / 100.0) AS unit FROM s)
SELECT l_orderkey, abs(unit - total) / unit >= 0.02 AS needs_review, round(abs(unit - total) / unit, 6) AS divergence_pct FROM u""")
def reconcile_breakdown(t) -> DataFrame:
    """Components against a unit price that leaves them by up to four per cent."""
    b = budgets(t).withColumn("unit", budget.total_of(F.col("parts")) * (1 + (F.col("l_orderkey") % 9 - 4) / 100.0))
    return b.select("l_orderkey", budget.reconcile(F.col("unit"), F.col("parts")).alias("r")).select("l_orderkey", "r.needs_review", F.round("r.divergence_pct", 6).alias("divergence_pct"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - p_retailprice * l_quantity) / l_extendedprice > 0.005 AS diverges FROM lineitem JOIN part ON p_partkey = l_partkey""")
def detect_divergence(t) -> DataFrame:
    gap = F.abs(F.col("l_extendedprice") - F.col("p_retailprice") * F.col("l_quantity")) / F.col("l_extendedprice")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", (gap > 0.005).alias("diverges"))


@query(PARTS_SQL + "SELECT l_orderkey, count(*) AS n_parts, l_orderkey % 3 <> 0 AS scaled, TRUE AS sums_up FROM k GROUP BY 1")
def force_reconcile(t) -> DataFrame:
    """Components scaled to a price whatever it is, and left alone where it is their sum already."""
    b = budgets(t).withColumn("total", budget.total_of(F.col("parts"))).withColumn("price", F.col("total") * (1 + F.col("l_orderkey") % 3 * 0.04))
    r = b.select("l_orderkey", "price", "total", "parts", budget.force_scale(F.col("price"), F.col("parts")).alias("now"))
    n = F.size("now").cast("bigint")
    return r.select("l_orderkey", n.alias("n_parts"), (F.col("now") != F.col("parts")).alias("scaled"), (F.abs(budget.total_of(F.col("now")) - F.col("price")) <= 0.006 * n).alias("sums_up"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE (l_extendedprice * l_quantity / l_extendedprice) END, 4) AS yield_amount FROM lineitem""")
def normalize_yield(t) -> DataFrame:
    declared = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))
    got = budget.normalize_yield(F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice"), declared)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(got, 4).alias("yield_amount"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_quantity > 100000 AND l_linenumber < 3 AS review FROM lineitem")
def price_anomaly(t) -> DataFrame:
    unit = F.when(F.col("l_linenumber") < 3, "m2").otherwise("pa")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rules.price_anomaly(unit, F.col("l_extendedprice"), F.col("l_quantity")).alias("review"))


@query(PARTS_SQL + """, s AS (SELECT l_orderkey, sum(total) AS total, list_extract([1.0, 1.2, 2.0], CAST(l_orderkey % 3 AS INTEGER) + 1) AS ratio, l_orderkey % 2 = 0 AS conv FROM k GROUP BY 1)
SELECT l_orderkey, round(total * CASE WHEN conv AND ratio > 1.05 THEN 2 ELSE 1 END, 2) AS total, NOT conv AND ratio > 1.5 AS event FROM s""")
def breakdown_defensive_scale(t) -> DataFrame:
    """Components that a unit conversion left behind scaled by it, and those too far from their price reported."""
    ratio = F.get(F.array(*map(F.lit, (1.0, 1.2, 2.0))), (F.col("l_orderkey") % 3).cast("int"))
    conv = F.col("l_orderkey") % 2 == 0
    b = budgets(t).withColumn("price", budget.total_of(F.col("parts")) / ratio)
    r = b.select("l_orderkey", budget.defensive_scale(F.col("parts"), F.col("price"), F.when(conv, 1.0), F.when(conv, 2.0)).alias("r"))
    return r.select("l_orderkey", F.round(budget.total_of(F.col("r.parts")), 2).alias("total"), "r.event")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount > 0.05 AND l_linenumber IN (1, 2) AND l_returnflag <> 'R' AS hidden FROM lineitem")
def hidden_dimension_flag(t) -> DataFrame:
    unit = F.when(F.col("l_linenumber").isin(1, 2), "ud").otherwise("m2")
    flag = (F.col("l_discount") > 0.05) & unit.isin("u", "ud", "uds", "pa") & (F.col("l_returnflag") != "R")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("hidden"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 >= 0.85 AND CASE l_linenumber % 5 WHEN 0 THEN 'm2' WHEN 1 THEN 'm2' WHEN 2 THEN 'h' WHEN 3 THEN 'ud' END
  = CASE l_partkey % 4 WHEN 0 THEN 'm2' WHEN 1 THEN 'm2' WHEN 2 THEN 'ud' END THEN 'flash' ELSE 'pro' END AS tier FROM lineitem""")
def select_tier(t) -> DataFrame:
    """Units of candidates and lines in several spellings, unknown ones and none among them."""
    one_of = lambda key, *names: F.get(F.array(*map(F.lit, names)), key.cast("int"))
    candidate = one_of(F.col("l_linenumber") % 5, "m²", " M2", "h", "Uds", None)
    line = one_of(F.col("l_partkey") % 4, "m2", "m²", "ud", "zzz")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", budget.select_tier(F.col("l_quantity") / 50, candidate, line).alias("tier"))


@query("SELECT p_partkey, contains(lower(p_name), 'medios') AND regexp_matches(lower(p_name), 'auxiliares|ejecución|ejecucion') AS ancillary FROM part")
def medios_predicate(t) -> DataFrame:
    return t.part.select("p_partkey", budget.is_ancillary(F.col("p_name")).alias("ancillary"))


@query("""WITH p AS (SELECT p_type, sum(l_extendedprice) AS pem FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT contains(p_name, 'red') GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(100 * l_extendedprice / pem, 6) AS pct FROM lineitem JOIN part ON p_partkey = l_partkey JOIN p USING (p_type)""")
def agg_pem_by_chapter(t) -> DataFrame:
    """Chapter totals without ancillary lines, joined back for the second pass."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    pem = rows.where(~F.contains("p_name", F.lit("red"))).groupBy("p_type").agg(F.sum("l_extendedprice").alias("pem"))
    return rows.join(pem, "p_type").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100 / F.col("pem"), 6).alias("pct"))


@query("""SELECT p_type AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, count(*) FILTER (WHERE p_size < 5) AS n_issues, count(*) FILTER (WHERE p_size < 5) * 1.0 / count(*) > 0.05 AS flagged FROM part GROUP BY 1""")
def agg_catalog_audit(t) -> DataFrame:
    whole = t.part.agg(F.count("*").alias("all"))
    per = t.part.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), count_where(F.col("p_size") < 5).alias("n_issues"))
    return per.crossJoin(F.broadcast(whole)).select("category", "n", F.round(F.col("n") * 100.0 / F.col("all"), 6).alias("pct"), "n_issues", (F.col("n_issues") / F.col("n") > 0.05).alias("flagged"))


@query("""SELECT l_returnflag AS match_kind, l_linenumber AS unit, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_flagged FROM lineitem GROUP BY 1, 2""")
def agg_diagnose_patterns(t) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("match_kind"), F.col("l_linenumber").alias("unit")).agg(F.count("*").alias("n"), count_where(F.col("l_discount") > 0.05).alias("n_flagged"))


@query("SELECT p_brand AS reason, count(*) AS n, min(p_name) AS example FROM part GROUP BY 1 HAVING count(*) >= 2")
def agg_fragment_by_reason(t) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("reason")).agg(F.count("*").alias("n"), F.min("p_name").alias("example")).where("n >= 2")


@query("SELECT l_partkey, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_order FROM lineitem GROUP BY 1")
def agg_resource_dedup(t) -> DataFrame:
    """First occurrence of each component code."""
    first = F.min_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return t.lineitem.groupBy("l_partkey").agg(first.alias("first_order"))


@query("""WITH d AS (SELECT abs(l_extendedprice - p_retailprice * l_quantity) / (p_retailprice * l_quantity) AS d FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_retailprice > 0),
r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT round((SELECT median(d) FROM d), 6) AS p50, round((SELECT max(d) FROM r WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT)), 6) AS p95""")
def agg_price_delta_percentiles(t) -> DataFrame:
    """Median by interpolation; the 95th percentile by the lower index, both from places in the whole order."""
    base = F.col("p_retailprice") * F.col("l_quantity")
    d = t.lineitem.join(t.part.where("p_retailprice > 0"), F.col("l_partkey") == F.col("p_partkey")).select((F.abs(F.col("l_extendedprice") - base) / base).alias("d"))
    p = percentiles(d, "d", p50=("middle", 0.5), p95=("lower", 0.95))
    return p.select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""SELECT p_type AS chapter, count(*) FILTER (WHERE p_size > 10) AS n_now, count(*) AS n_base, 1 - count(*) FILTER (WHERE p_size > 10) * 1.0 / count(*) <= 0.2 AS passes FROM part GROUP BY 1""")
def agg_regression_guard(t) -> DataFrame:
    now = count_where(F.col("p_size") > 10)
    per = t.part.groupBy(F.col("p_type").alias("chapter")).agg(now.alias("n_now"), F.count("*").alias("n_base"))
    return per.withColumn("passes", 1 - F.col("n_now") / F.col("n_base") <= 0.2)


@query("""WITH a AS (SELECT l_orderkey, list_distinct(list(p_type)) AS have, sum(l_extendedprice) AS pem FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, list_sort(list_filter(['ECONOMY', 'LARGE', 'SMALL'], lambda x: list_contains(have, x))) AS present, list_sort(list_filter(['ECONOMY', 'LARGE', 'SMALL'], lambda x: NOT list_contains(have, x))) AS missing, pem BETWEEN 50000 AND 200000 AS in_range FROM a""")
def agg_qualitative(t) -> DataFrame:
    wanted = F.array(*map(F.lit, ("ECONOMY", "LARGE", "SMALL")))
    a = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("have"), F.sum("l_extendedprice").alias("pem"))
    return a.select("l_orderkey", F.sort_array(F.array_intersect(wanted, "have")).alias("present"), F.sort_array(F.array_except(wanted, "have")).alias("missing"), F.col("pem").between(50000, 200000).alias("in_range"))


@query("""WITH m AS (SELECT coalesce(CASE WHEN p_size > 20 THEN p_brand END, 'REVIEW:' || p_name) AS key, p_partkey, p_size, p_retailprice, p_size > 20 AS matched FROM part)
SELECT key, CAST(CASE WHEN bool_or(matched) THEN sum(p_size) ELSE arg_max(p_size, p_partkey) END AS BIGINT) AS quantity,
  CAST(CASE WHEN bool_or(matched) THEN arg_min(p_retailprice, p_partkey) ELSE 0 END AS DOUBLE) AS unit_price,
  CAST(CASE WHEN bool_or(matched) THEN round(arg_min(p_retailprice, p_partkey) * sum(p_size), 2) ELSE 0 END AS DOUBLE) AS total FROM m GROUP BY 1""")
def agg_assembly_merge(t) -> DataFrame:
    """Lines of one catalog code add up, at the price of the first; of lines to be reviewed the last takes the place of those before."""
    matched = F.col("p_size") > 20
    key = F.coalesce(F.when(matched, F.col("p_brand")), F.concat(F.lit("REVIEW:"), "p_name"))
    return rules.merged_assembly(t.part.select(key.alias("key"), "p_partkey", matched.alias("matched"), F.col("p_size").alias("quantity"), F.col("p_retailprice").alias("price")), "p_partkey")


@query("SELECT p_partkey, p_size / 50.0 AS score FROM part WHERE p_size / 50.0 > 0.60")
def filter_viable_candidates(t) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("score")).where("score > 0.60")


@query("""SELECT p_partkey, round(p_retailprice * 0.6 + p_retailprice * 0.4 * (1 + CASE WHEN contains(p_name, 'ring') THEN 0.10 WHEN contains(p_name, 'red') THEN 0.08 ELSE 0.05 END), 6) AS price FROM part""")
def material_substitution_price(t) -> DataFrame:
    waste = F.when(F.contains("p_name", F.lit("ring")), 0.10).when(F.contains("p_name", F.lit("red")), 0.08).otherwise(0.05)
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.round(price * 0.6 + price * 0.4 * (1 + waste), 6).alias("price"))


LADDER = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'LABOR' WHEN 'A' THEN 'MATERIAL' ELSE 'OTHER' END AS type, l_linestatus = 'F' AND l_quantity > 40 AND l_returnflag <> 'N' AS verified, l_extendedprice AS price FROM lineitem),
r AS (SELECT *, CASE WHEN verified THEN 0 WHEN type = 'LABOR' THEN 1 WHEN type = 'MATERIAL' THEN 2 ELSE 3 END AS step FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY step, l_linenumber, l_partkey, price) AS n FROM r) """


@query(LADDER + """SELECT l_orderkey, CASE step WHEN 2 THEN round(price * 1.4, 4) WHEN 3 THEN NULL ELSE round(price, 4) END AS price,
  CASE step WHEN 0 THEN CASE type WHEN 'LABOR' THEN 95 ELSE 75 END WHEN 1 THEN 85 WHEN 2 THEN 60 ELSE 30 END AS confidence FROM f WHERE n = 1""")
def match_ladder(t) -> DataFrame:
    """Price of an order from its candidates: a verified one, else labour, else material with a surcharge, else an estimate."""
    kind = F.when(F.col("l_returnflag") == "R", "LABOR").when(F.col("l_returnflag") == "A", "MATERIAL").otherwise("OTHER")
    verified = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40) & (F.col("l_returnflag") != "N")
    part = F.struct("l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), kind.alias("type"), verified.alias("verified"))
    orders = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(part)).alias("candidates"))
    m = orders.select("l_orderkey", rules.match_ladder(F.col("candidates")).alias("m"))
    return m.select("l_orderkey", F.round("m.price", 4).alias("price"), "m.confidence")


@query("""WITH s AS (SELECT coalesce(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_extendedprice END), 0) AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS matched FROM lineitem)
SELECT round(s, 2) AS subtotal, round(s * 0.10, 2) AS overhead, round(s * 0.15, 2) AS benefit, round(s * 1.25 * 0.10, 2) AS vat, round(s * 1.25 * 1.10, 2) AS total, matched FROM s""")
def measurement_totals(t) -> DataFrame:
    """Sums of a priced measurement: lines without a price count as nothing."""
    price = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))
    return rules.measurement_totals(t.lineitem.select(price.alias("price"), (F.col("l_returnflag") == "R").alias("matched")))


@query("""SELECT c_custkey, CASE WHEN a.p_partkey IS NOT NULL THEN 'partida' WHEN m.p_partkey IS NOT NULL THEN 'material' WHEN s.total IS NOT NULL THEN 'assembly' ELSE 'ask_user' END AS kind,
  round(coalesce(a.p_retailprice, m.p_retailprice, s.total), 2) AS price FROM customer LEFT JOIN part a ON a.p_partkey = c_custkey AND a.p_size > 40 LEFT JOIN part m ON m.p_partkey = c_custkey AND m.p_size BETWEEN 25 AND 40
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) s ON s.l_orderkey = c_custkey""")
def union_resolve_item(t) -> DataFrame:
    """An item as a line of the catalog, else a material, else the sum of its assembly, else a row that asks."""
    item = lambda cond, kind: t.part.where(cond).select(F.col("p_partkey").alias("c_custkey"), F.struct(F.lit(kind).alias("kind"), F.col("p_retailprice").alias("price")).alias(kind))
    assembly = t.lineitem.groupBy(F.col("l_orderkey").alias("c_custkey")).agg(F.struct(F.lit("assembly").alias("kind"), F.sum("l_extendedprice").alias("price")).alias("assembly"))
    rows = t.customer.select("c_custkey").join(item("p_size > 40", "partida"), "c_custkey", "left").join(item("p_size BETWEEN 25 AND 40", "material"), "c_custkey", "left").join(assembly, "c_custkey", "left")
    ask = F.struct(F.lit("ask_user").alias("kind"), F.lit(None).cast("double").alias("price"))
    return rows.select("c_custkey", F.coalesce("partida", "material", "assembly", ask).alias("x")).select("c_custkey", "x.kind", F.round("x.price", 2).alias("price"))


@query("""SELECT vec_id, label IS NULL OR label % 4 = 1 AS never, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 50 AS INT) AS page
FROM embeddings WHERE label % 4 IN (1, 3) OR label IS NULL""")
def vectorize_missing(t) -> DataFrame:
    """Rows without a vector, or with an empty one, in pages of fifty by id."""
    vector = F.when(F.col("label") % 4 == 3, F.array().cast("array<float>")).when(F.col("label") % 4 != 1, F.col("embedding"))
    rows = t.embeddings.select("vec_id", vector.alias("embedding")).where(F.col("embedding").isNull() | (F.size("embedding") == 0))
    paged = positions(rows.select("vec_id", F.col("embedding").isNull().alias("never")), "vec_id")
    return paged.select("vec_id", "never", F.floor(F.col("position") / 50).cast("int").alias("page"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CAST(0 AS BIGINT) AS refunds,
  count(*) AS total, round(max(CASE WHEN event_type <> 'error' THEN value END) * 2, 4) AS largest FROM events GROUP BY 1""")
def map_counters(t) -> DataFrame:
    """Counters kept in a map of each user, read with a default for those that were never raised, and its values mapped."""
    kinds = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    maps = kinds.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "most")))).alias("m"))
    counter = lambda name: F.coalesce(F.try_element_at("m", F.lit(name))["n"], F.lit(0)).cast("bigint").alias(name)
    doubled = F.map_values(F.transform_values(F.map_filter("m", lambda k, _: k != "error"), lambda _, v: v["most"] * 2))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, v: s + v["n"])
    return maps.select("user_id", counter("view").alias("views"), counter("purchase").alias("purchases"), counter("refund").alias("refunds"), total.alias("total"), F.round(F.array_max(doubled), 4).alias("largest"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN json_extract(props, '$.k')::DOUBLE ELSE 1.0 END AS price FROM events""")
def alias_chain(t) -> DataFrame:
    """A price under the first of its names that a record has: priceTotal, unit_price, the key of its properties, else 1."""
    record = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("priceTotal"), F.col("value").alias("unit_price")))).when(F.col("event_id") % 3 == 1, F.col("props"))
    return t.events.select("event_id", first_named(record, ("priceTotal", "unit_price", "k"), F.lit(1.0)).alias("price"))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) AND (embedding IS NULL OR len(embedding) <> 64)")
def repair_vectors(t) -> DataFrame:
    return t.embeddings.where(F.col("label").isin(1, 2) & (F.col("embedding").isNull() | (F.size("embedding") != 64))).select("vec_id", "label")


@query("SELECT p_partkey FROM part WHERE NOT (p_size < 5 OR p_type = 'PROMO' OR p_retailprice > 1800)")
def cleanup_multi_predicate(t) -> DataFrame:
    return t.part.where(~((F.col("p_size") < 5) | (F.col("p_type") == "PROMO") | (F.col("p_retailprice") > 1800))).select("p_partkey")


@query("""SELECT p_partkey, CASE WHEN r BETWEEN 90 AND 110 THEN 'times_100' WHEN r < 0.9 OR r > 1.1 THEN 'suspicious' ELSE 'ok' END AS scale FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice * 100 ELSE p_retailprice + p_size * 5 END / p_retailprice AS r FROM part)""")
def price_scale_audit(t) -> DataFrame:
    stored = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") * 100).otherwise(F.col("p_retailprice") + F.col("p_size") * 5)
    return t.part.select("p_partkey", rules.price_scale(F.col("p_retailprice"), stored).alias("scale"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_codes(t) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH f AS (SELECT p_brand || p_size % 9 AS folder, CASE p_type WHEN 'SMALL' THEN 'MEDICION' WHEN 'LARGE' THEN 'PRESUPUESTO' WHEN 'PROMO' THEN 'OTRO' WHEN 'ECONOMY' THEN 'FACTURA' ELSE 'PLANO' END || '_' || p_partkey || '.pdf' AS name, p_size * 1000 + p_partkey % 7 AS size FROM part),
m AS (SELECT folder, arg_max(name, (size, name)) AS measurement FROM f WHERE name LIKE 'MEDICION_%' GROUP BY 1),
c AS (SELECT f.folder, f.name, f.size, CASE WHEN name LIKE 'PRESUPUESTO_%' THEN 1 WHEN name LIKE 'OTRO_%' THEN 2 ELSE 3 END AS step FROM f JOIN m ON m.folder = f.folder AND f.name <> m.measurement WHERE name NOT LIKE '%CERTIFICACION%' AND name NOT LIKE '%FACTURA%')
SELECT folder, m.measurement, first(c.name ORDER BY c.step, c.size DESC, c.name DESC) AS budget FROM m JOIN c USING (folder) GROUP BY 1, 2""")
def pair_largest_files(t) -> DataFrame:
    """Of each folder the largest measurement with the largest budget: by name, else other files, else any but invoices."""
    kind = F.when(F.col("p_type") == "SMALL", "MEDICION").when(F.col("p_type") == "LARGE", "PRESUPUESTO").when(F.col("p_type") == "PROMO", "OTRO").when(F.col("p_type") == "ECONOMY", "FACTURA").otherwise("PLANO")
    name = F.concat(kind, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    rows = t.part.select(F.concat("p_brand", (F.col("p_size") % 9).cast("string")).alias("folder"), name.alias("name"), (F.col("p_size") * 1000 + F.col("p_partkey") % 7).alias("size"))
    return files.largest_pairs(rows)


@query(PARTS_SQL + """, i AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Partidas Generales' ELSE o_orderpriority END AS chapter, ['execution', 'labor', 'complete'][o_orderkey % 3 + 1] AS mode, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS pieces,
  o_totalprice AS total, coalesce(sum(k.total) FILTER (WHERE is_variable), 0) AS variable, coalesce(sum(k.total) FILTER (WHERE code LIKE 'mo%'), 0) AS labor, count(l_orderkey) AS n FROM orders LEFT JOIN k ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT chapter, mode, count(*) AS n_items, round(sum(CASE WHEN n = 0 OR mode = 'complete' THEN total WHEN mode = 'execution' THEN greatest(0, total - variable * pieces) ELSE labor * pieces END), 2) AS total FROM i GROUP BY 1, 2""")
def group_items_pdf(t) -> DataFrame:
    """Items (orders) by chapter, each at what it costs in its mode."""
    k = F.col("o_orderkey")
    items = t.orders.join(budgets(t), k == F.col("l_orderkey"), "left").select(
        F.coalesce(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")), F.lit("Partidas Generales")).alias("chapter"),
        F.get(F.array(F.lit("execution"), F.lit("labor"), F.lit("complete")), (k % 3).cast("int")).alias("mode"),
        F.when(k % 2 == 1, 2).alias("quantity"), "o_totalprice", "parts",
    )
    costs = items.withColumn("total", mode_total(F.col("mode"), F.col("o_totalprice"), F.col("quantity"), F.col("parts")))
    return costs.groupBy("chapter", "mode").agg(F.count("*").alias("n_items"), F.round(F.sum("total"), 2).alias("total"))


@query("""SELECT o_orderkey, list_contains(['O>F', 'P>O'], o_orderstatus || '>' || CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'P' THEN 'F' ELSE 'O' END) AS allowed FROM orders""")
def transition_check(t) -> DataFrame:
    after = F.when(F.col("o_orderstatus") == "O", "F").when(F.col("o_orderstatus") == "P", "F").otherwise("O")
    return t.orders.select("o_orderkey", rules.transition_allowed(F.col("o_orderstatus"), after, {"O": ("F",), "P": ("O",)}).alias("allowed"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM embeddings, q),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 15),
b AS (SELECT query_id, vec_id, score * (1 + 0.5 * CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) * CASE WHEN label > 6 THEN 0.3 ELSE 1 END AS score FROM o)
SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM b) WHERE r <= 5""")
def topk_oversample(t) -> DataFrame:
    """Three times as many candidates, a keyword boost and a dimension penalty, then the cut."""
    from pyspark.sql import Window

    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    wide = nearest(queries, t.embeddings, 15, "query_id", "vec_id").join(t.embeddings.select("vec_id", "label"), "vec_id")
    boost = 1 + 0.5 * F.when(F.col("label") % 2 == 0, 1).otherwise(0)
    ranked = wide.withColumn("score", F.col("score") * boost * F.when(F.col("label") > 6, 0.3).otherwise(1.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("r", F.row_number().over(order)).where("r <= 5").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query()
def fuzzy_ratio_items(t) -> DataFrame:
    """Similarity of each benchmark item to the next one."""
    b = t.benchmark.select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    pairs = b.join(nxt, "item_id")
    return pairs.select("item_id", fuzzy_ratio(F.col("text"), F.col("other")).alias("ratio"), hybrid_similarity(F.col("text"), F.col("other")).alias("similarity"))
