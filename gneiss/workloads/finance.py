"""Project, expense and provider financials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.aggregate import count_where, provider_spend, ratio, sum_where
from gneiss.workloads.base import VIEWS, query

def valid() -> Column:
    return F.col("status") == "validada"


AS_OF = "2002-01-01"
#: VAT share and Spanish month labels.
VAT = 0.21
MONTHS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def r(column, places: int = 4):
    return F.round(column, places)


#: So many lines a task sums up and sorts: more lines make more tasks, not larger ones.
ROWS_A_TASK = 500_000


@query(VIEWS + """, spend AS (
  SELECT provider_id, sum(total) AS spend, count(*) AS n_expenses, count(DISTINCT project_id) AS n_projects
  FROM expenses WHERE status = 'validada' GROUP BY 1)
SELECT s.provider_id, p.s_name AS provider_name, round(s.spend, 4) AS spend, s.n_expenses, s.n_projects,
       round(s.spend / s.n_expenses, 4) AS avg_expense, round(100 * s.spend / sum(s.spend) OVER (), 6) AS risk_pct
FROM spend s JOIN supplier p ON p.s_suppkey = s.provider_id""")
def agg_provider_ranking(t) -> DataFrame:
    ranked = provider_spend(t.expenses.where(valid()))
    named = ranked.join(t.supplier, F.col("provider_id") == F.col("s_suppkey"))
    return named.select(
        "provider_id",
        F.col("s_name").alias("provider_name"),
        r("spend").alias("spend"),
        "n_expenses",
        "n_projects",
        r(F.col("spend") / F.col("n_expenses")).alias("avg_expense"),
        r("risk_pct", 6).alias("risk_pct"),
    )


@query(VIEWS + """SELECT provider_id, chapter, round(sum(total), 4) AS amount FROM expenses JOIN chapters USING (part_id)
WHERE status = 'validada' GROUP BY 1, 2""")
def agg_provider_chapter(t) -> DataFrame:
    return t.expenses.where(valid()).join(t.chapters, "part_id").groupBy("provider_id", "chapter").agg(r(F.sum("total")).alias("amount"))


@query(VIEWS + """SELECT strftime(invoice_date, '%Y-%m') AS month, round(sum(total), 4) AS total, count(*) AS n_expenses,
  list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], CAST(min(month(invoice_date)) AS INTEGER)) || ' ' || min(year(invoice_date)) AS label
FROM expenses WHERE status = 'validada' GROUP BY 1""")
def agg_monthly_expense(t) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("invoice_date"))
    months = t.expenses.where(valid()).withColumn("month", F.date_format("invoice_date", "yyyy-MM"))
    return months.groupBy("month").agg(
        r(F.sum("total")).alias("total"),
        F.count("*").alias("n_expenses"),
        F.min(F.concat(label, F.lit(" "), F.year("invoice_date").cast("string"))).alias("label"),
    )


@query(VIEWS + """, e AS (SELECT project_id, sum(total) FILTER (WHERE status = 'validada') AS real_cost,
   count(*) FILTER (WHERE status = 'validada') AS n_valid, count(*) FILTER (WHERE status = 'pendiente') AS n_pending FROM expenses GROUP BY 1),
x AS (SELECT p.*, coalesce(e.real_cost, 0) AS real_cost, coalesce(n_valid, 0) AS n_valid, coalesce(n_pending, 0) AS n_pending,
   greatest(1, date_diff('day', start_date, TIMESTAMP '2002-01-01')) AS days FROM projects p LEFT JOIN e USING (project_id))
SELECT project_id, round(real_cost, 4) AS real_cost, round(estimate - real_cost, 4) AS margin,
  round(CASE WHEN estimate > 0 THEN 100 * (real_cost - estimate) / estimate ELSE 0 END, 6) AS deviation_pct,
  round(real_cost / days, 9) AS burn_rate, n_valid, n_pending FROM x""")
def agg_project_financials(t) -> DataFrame:
    e = t.expenses.groupBy("project_id").agg(
        sum_where("total", valid()).alias("real_cost"), count_where(valid()).alias("n_valid"), count_where(~valid()).alias("n_pending")
    )
    days = F.greatest(F.lit(1), F.datediff(F.lit(AS_OF), "start_date"))
    x = t.projects.join(e, "project_id", "left").fillna({"real_cost": 0.0, "n_valid": 0, "n_pending": 0})
    cost, estimate = F.col("real_cost"), F.col("estimate")
    return x.select(
        "project_id",
        r(cost).alias("real_cost"),
        r(estimate - cost).alias("margin"),
        r(ratio((cost - estimate) * 100, estimate), 6).alias("deviation_pct"),
        r(cost / days, 9).alias("burn_rate"),
        "n_valid",
        "n_pending",
    )


@query(VIEWS + """, e AS (SELECT sum(total) AS spent, sum(tax_amount) AS vat_paid FROM expenses WHERE status = 'validada'),
p AS (SELECT sum(estimate) AS billed, sum(estimate * 0.21 / 1.21) AS vat_collected FROM projects)
SELECT round(billed, 2) AS billed, round(spent, 2) AS spent, round(billed - spent, 2) AS profit,
  round(CASE WHEN billed > 0 THEN 100 * (billed - spent) / billed ELSE 0 END, 6) AS margin_pct, round(vat_paid, 2) AS vat_paid, round(vat_collected, 2) AS vat_collected FROM e, p""")
def agg_global_financials(t) -> DataFrame:
    e = t.expenses.where(valid()).agg(F.sum("total").alias("spent"), F.sum("tax_amount").alias("vat_paid"))
    p = t.projects.agg(F.sum("estimate").alias("billed"), F.sum(F.col("estimate") * VAT / (1 + VAT)).alias("vat_collected"))
    billed, spent = F.col("billed"), F.col("spent")
    return p.crossJoin(F.broadcast(e)).select(
        r(billed, 2).alias("billed"),
        r(spent, 2).alias("spent"),
        r(billed - spent, 2).alias("profit"),
        r(ratio((billed - spent) * 100, billed), 6).alias("margin_pct"),
        r("vat_paid", 2).alias("vat_paid"),
        r("vat_collected", 2).alias("vat_collected"),
    )


@query(VIEWS + "SELECT status, count(*) AS n FROM projects GROUP BY 1")
def agg_by_status(t) -> DataFrame:
    return t.projects.groupBy("status").agg(F.count("*").alias("n"))


@query(VIEWS + """SELECT provider_id, round(sum(total), 4) AS spend, count(*) AS n FROM expenses WHERE status = 'validada' GROUP BY 1
ORDER BY sum(total) DESC, provider_id LIMIT 5""")
def agg_top_providers(t) -> DataFrame:
    per = t.expenses.where(valid()).groupBy("provider_id").agg(F.sum("total").alias("s"), F.count("*").alias("n"))
    return per.orderBy(F.desc("s"), "provider_id").limit(5).select("provider_id", r("s").alias("spend"), "n")


@query(VIEWS + """, phase AS (SELECT project_id, line_no AS phase, sum(total) FILTER (WHERE status = 'validada') AS real_cost, sum(total) AS estimate FROM expenses GROUP BY 1, 2)
SELECT project_id, phase, round(coalesce(real_cost, 0) - estimate, 4) AS deviation,
  round(CASE WHEN estimate > 0 THEN 100 * (coalesce(real_cost, 0) - estimate) / estimate ELSE 0 END, 6) AS deviation_pct FROM phase""")
def agg_phase_comparison(t) -> DataFrame:
    phases = t.expenses.groupBy("project_id", F.col("line_no").alias("phase")).agg(sum_where("total", valid()).alias("real_cost"), F.sum("total").alias("estimate"))
    gap = F.col("real_cost") - F.col("estimate")
    return phases.select("project_id", "phase", r(gap).alias("deviation"), r(ratio(gap * 100, F.col("estimate")), 6).alias("deviation_pct"))


ACCURACY = """, e AS (SELECT project_id, sum(total) AS cost FROM expenses WHERE status = 'validada' GROUP BY 1 HAVING sum(total) > 0),
dev AS (SELECT p.project_id, p.priority, 100 * (e.cost - p.estimate) / p.estimate AS dev FROM projects p JOIN e USING (project_id) WHERE p.estimate > 0)
"""


def deviations(t) -> DataFrame:
    """Per cent by which validated cost leaves the estimate, for projects that have both."""
    cost = t.expenses.where(valid()).groupBy("project_id").agg(F.sum("total").alias("cost")).where("cost > 0")
    return t.projects.where("estimate > 0").join(cost, "project_id").select("project_id", "priority", (100 * (F.col("cost") - F.col("estimate")) / F.col("estimate")).alias("dev"))


@query(VIEWS + ACCURACY + """SELECT count(*) AS n_projects, round(avg(dev), 6) AS mean_deviation, round(median(dev), 6) AS median_deviation,
  arg_min(project_id, abs(dev)) AS best_project, arg_max(project_id, abs(dev)) AS worst_project FROM dev""")
def agg_budget_accuracy(t) -> DataFrame:
    return deviations(t).agg(
        F.count("*").alias("n_projects"),
        r(F.avg("dev"), 6).alias("mean_deviation"),
        r(F.median("dev"), 6).alias("median_deviation"),
        F.min_by("project_id", F.abs("dev")).alias("best_project"),
        F.max_by("project_id", F.abs("dev")).alias("worst_project"),
    )


@query(VIEWS + ACCURACY + "SELECT priority, round(avg(dev), 6) AS avg_deviation, count(*) AS n FROM dev GROUP BY 1 ORDER BY abs(avg(dev)) DESC, priority")
def sort_abs_desc(t) -> DataFrame:
    per = deviations(t).groupBy("priority").agg(F.avg("dev").alias("d"), F.count("*").alias("n"))
    return per.orderBy(F.abs("d").desc(), "priority").select("priority", r("d", 6).alias("avg_deviation"), "n")


EVM = """, e AS (SELECT project_id, sum(total) AS ac FROM expenses WHERE status = 'validada' GROUP BY 1),
l AS (SELECT project_id, avg(CASE WHEN status = 'validada' THEN 1.0 ELSE 0.0 END) AS progress FROM expenses GROUP BY 1),
x AS (SELECT p.project_id, p.estimate AS bac, coalesce(e.ac, 0) AS ac, coalesce(l.progress, 0) AS progress,
   least(1.0, greatest(0, date_diff('day', p.start_date, TIMESTAMP '2002-01-01')) / 1500.0) AS elapsed
   FROM projects p LEFT JOIN e USING (project_id) LEFT JOIN l USING (project_id)),
v AS (SELECT *, bac * elapsed AS pv, bac * progress AS ev FROM x),
k AS (SELECT *, CASE WHEN pv > 0 THEN ev / pv ELSE 1 END AS spi, CASE WHEN ac > 0 THEN ev / ac ELSE 1 END AS cpi FROM v)
"""


@query(VIEWS + EVM + """SELECT project_id, round(pv, 7) AS pv, round(ev, 7) AS ev, round(ac, 4) AS ac, round(spi, 6) AS spi, round(cpi, 6) AS cpi,
  round(CASE WHEN cpi > 0 THEN bac / cpi ELSE bac END, 7) AS eac, round(CASE WHEN cpi > 0 THEN bac / cpi ELSE bac END - ac, 7) AS etc, round(bac - CASE WHEN cpi > 0 THEN bac / cpi ELSE bac END, 7) AS vac,
  CASE WHEN spi > 1.05 THEN 'ahead' WHEN spi < 0.95 THEN 'behind' ELSE 'on_track' END AS schedule_status,
  CASE WHEN cpi > 1.05 THEN 'under' WHEN cpi < 0.95 THEN 'over' ELSE 'on_budget' END AS cost_status FROM k""")
def agg_evm(t) -> DataFrame:
    """Earned value of every project at one date."""
    per = t.expenses.groupBy("project_id").agg(sum_where("total", valid()).alias("ac"), F.avg(F.when(valid(), 1.0).otherwise(0.0)).alias("progress"))
    x = t.projects.join(per, "project_id", "left").fillna({"ac": 0.0, "progress": 0.0})
    elapsed = F.least(F.lit(1.0), F.greatest(F.lit(0), F.datediff(F.lit(AS_OF), "start_date")) / 1500.0)
    v = x.select("project_id", F.col("estimate").alias("bac"), "ac", (F.col("estimate") * elapsed).alias("pv"), (F.col("estimate") * F.col("progress")).alias("ev"))
    k = v.withColumn("spi", ratio(F.col("ev"), F.col("pv"), 1.0)).withColumn("cpi", ratio(F.col("ev"), F.col("ac"), 1.0))
    k = k.withColumn("eac", F.when(F.col("cpi") > 0, F.col("bac") / F.col("cpi")).otherwise(F.col("bac")))
    band = lambda c, high, low, mid: F.when(F.col(c) > 1.05, high).when(F.col(c) < 0.95, low).otherwise(mid)
    return k.select(
        "project_id", r("pv", 7).alias("pv"), r("ev", 7).alias("ev"), r("ac").alias("ac"), r("spi", 6).alias("spi"), r("cpi", 6).alias("cpi"),
        r("eac", 7).alias("eac"), r(F.col("eac") - F.col("ac"), 7).alias("etc"), r(F.col("bac") - F.col("eac"), 7).alias("vac"),
        band("spi", "ahead", "behind", "on_track").alias("schedule_status"), band("cpi", "under", "over", "on_budget").alias("cost_status"),
    )


@query(VIEWS + """SELECT project_id, coalesce(CAST(line_no AS VARCHAR), 'unassigned') AS phase, round(sum(total), 4) AS cost, round(sum(sum(total)) OVER (PARTITION BY project_id), 4) AS project_cost
FROM expenses WHERE status = 'validada' GROUP BY 1, 2""")
def agg_phase_cost(t) -> DataFrame:
    per = t.expenses.where(valid()).groupBy("project_id", F.coalesce(F.col("line_no").cast("string"), F.lit("unassigned")).alias("phase")).agg(F.sum("total").alias("c"))
    return per.select("project_id", "phase", r("c").alias("cost"), r(F.sum("c").over(Window.partitionBy("project_id"))).alias("project_cost"))


@query(VIEWS + """, w AS (SELECT project_id, total AS est, CASE WHEN status = 'validada' THEN 100.0 ELSE 40.0 END AS progress FROM expenses)
SELECT project_id, round(sum(progress * est) / CASE WHEN sum(est) = 0 THEN 1 ELSE sum(est) END, 6) AS weighted_progress, round(avg(progress), 6) AS avg_progress FROM w GROUP BY 1""")
def agg_weighted_progress(t) -> DataFrame:
    progress = F.when(valid(), 100.0).otherwise(40.0)
    whole = F.sum("total")
    return t.expenses.groupBy("project_id").agg(
        r(F.sum(progress * F.col("total")) / F.when(whole == 0, 1.0).otherwise(whole), 6).alias("weighted_progress"), r(F.avg(progress), 6).alias("avg_progress")
    )


@query(VIEWS + "SELECT project_id, round(avg(CASE WHEN status = 'validada' THEN 100.0 ELSE 0.0 END), 6) AS avg_progress FROM expenses GROUP BY 1")
def agg_avg_progress(t) -> DataFrame:
    return t.expenses.groupBy("project_id").agg(r(F.avg(F.when(valid(), 100.0).otherwise(0.0)), 6).alias("avg_progress"))


@query(VIEWS + """SELECT round(sum(total) FILTER (WHERE status = 'validada'), 2) AS validated, round(sum(total) FILTER (WHERE status = 'pendiente'), 2) AS pending,
  round(coalesce(sum(total) FILTER (WHERE status = 'rechazada'), 0), 2) AS rejected FROM expenses""")
def agg_expense_status_totals(t) -> DataFrame:
    each = {"validated": "validada", "pending": "pendiente", "rejected": "rechazada"}
    return t.expenses.agg(*(r(sum_where("total", F.col("status") == s), 2).alias(a) for a, s in each.items()))


@query("""SELECT c_mktsegment AS stage, round(sum(coalesce(nullif(c_acctbal, 0), 0)), 2) AS value FROM customer GROUP BY 1""")
def agg_pipeline_value(t) -> DataFrame:
    value = F.coalesce(F.nullif(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0))
    return t.customer.groupBy(F.col("c_mktsegment").alias("stage")).agg(r(F.sum(value), 2).alias("value"))


@query("""WITH n AS (SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-01') AS now,
  count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-05-02' AND o_orderdate < TIMESTAMP '1998-06-01') AS before FROM orders)
SELECT now AS current, before AS previous, CASE WHEN before > 0 THEN CAST(floor(100.0 * (now - before) / before + 0.5) AS BIGINT) END AS delta_pct FROM n""")
def agg_period_delta(t) -> DataFrame:
    """Orders of the last 30 days against the 30 before, in whole per cent rounded half up."""
    end = F.lit("1998-07-01").cast("timestamp")
    inside = lambda a, b: (F.col("o_orderdate") >= F.date_sub(end, a)) & (F.col("o_orderdate") < F.date_sub(end, b))
    n = t.orders.agg(count_where(inside(30, 0)).alias("current"), count_where(inside(60, 30)).alias("previous"))
    change = F.floor((F.col("current") - F.col("previous")) * 100.0 / F.col("previous") + 0.5)
    return n.select("current", "previous", F.when(F.col("previous") > 0, change).alias("delta_pct"))


@query("SELECT coalesce(p_type, 'Uncategorized') AS chapter, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, chapter LIMIT 10")
def agg_chapter_topk(t) -> DataFrame:
    per = t.part.groupBy(F.coalesce("p_type", F.lit("Uncategorized")).alias("chapter")).agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "chapter").limit(10)


@query(VIEWS + """, c AS (SELECT project_id, chapter, sum(total) AS amount FROM expenses JOIN chapters USING (part_id) GROUP BY 1, 2),
b AS (SELECT project_id, sum(amount) AS subtotal, count(*) AS n_chapters FROM c GROUP BY 1)
SELECT project_id, n_chapters, round(subtotal, 4) AS subtotal, round(subtotal * 0.13, 8) AS gg, round(subtotal * 0.06, 8) AS bi,
  round(subtotal * 1.19 * 0.21, 8) AS tax, round(subtotal * 1.19 * 1.21, 8) AS total FROM b""")
def agg_budget_rollup(t) -> DataFrame:
    """Lines to chapters to budgets, with overhead, profit and tax."""
    chapter = t.expenses.join(t.chapters, "part_id").groupBy("project_id", "chapter").agg(F.sum("total").alias("amount"))
    s = F.col("s")
    return chapter.groupBy("project_id").agg(F.sum("amount").alias("s"), F.count("*").alias("n_chapters")).select(
        "project_id", "n_chapters", r(s).alias("subtotal"), r(s * 0.13, 8).alias("gg"), r(s * 0.06, 8).alias("bi"), r(s * 1.19 * 0.21, 8).alias("tax"), r(s * 1.19 * 1.21, 8).alias("total")
    )


@query(VIEWS + """, m AS (SELECT project_id, date_trunc('month', invoice_date) AS month, sum(total) AS cost FROM expenses WHERE status = 'validada' GROUP BY 1, 2),
cal AS (SELECT project_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY 1)
SELECT project_id, strftime(cal.month, '%Y-%m') AS month, round(coalesce(cost, 0), 4) AS cost,
  round(sum(coalesce(cost, 0)) OVER (PARTITION BY project_id ORDER BY cal.month), 4) AS running_cost FROM cal LEFT JOIN m USING (project_id, month)""")
def win_running_cost(t) -> DataFrame:
    """Cumulative validated cost by month, over every month between a project's first and last."""
    rows = t.expenses.where(valid()).select("project_id", F.trunc("invoice_date", "month").alias("month"), "total")
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.lineitem.count() // ROWS_A_TASK + 1)  # the count is in the files' footers
    m = rows.repartition(tasks, "project_id").groupBy("project_id", "month").agg(F.sum("total").alias("cost"))  # the only shuffle
    per = m.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "cost"))).alias("costs"), F.min("month").alias("a"), F.max("month").alias("b"))
    full = per.select("project_id", "costs", F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("month"))
    full = full.select("project_id", "month", F.coalesce(F.col("costs")[F.col("month")], F.lit(0.0)).alias("cost"))
    upto = Window.partitionBy("project_id").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select("project_id", F.date_format("month", "yyyy-MM").alias("month"), r("cost").alias("cost"), r(F.sum("cost").over(upto)).alias("running_cost"))


@query(VIEWS + """, x AS (SELECT project_id, estimate, start_date, unnest(generate_series(date_trunc('month', start_date), date_trunc('month', start_date) + INTERVAL 5 MONTH, INTERVAL 1 MONTH)) AS month
  FROM projects WHERE status = 'preparacion')
SELECT project_id, strftime(month, '%Y-%m') AS month, round(least(estimate, estimate * greatest(0, date_diff('day', start_date, month) + 30) / 150.0), 8) AS planned_value FROM x""")
def win_planned_value_curve(t) -> DataFrame:
    x = t.projects.where("status = 'preparacion'").withColumn("m", F.trunc("start_date", "month"))
    x = x.select("project_id", "estimate", "start_date", F.explode(F.expr("sequence(m, add_months(m, 5), INTERVAL 1 MONTH)")).alias("month"))
    done = F.greatest(F.lit(0), F.datediff("month", "start_date") + 30) / 150.0
    return x.select("project_id", F.date_format("month", "yyyy-MM").alias("month"), r(F.least("estimate", F.col("estimate") * done), 8).alias("planned_value"))


@query(VIEWS + "SELECT provider_id, round(100 * sum(total) / sum(sum(total)) OVER (), 6) AS pct FROM expenses GROUP BY 1")
def win_share_of_total(t) -> DataFrame:
    return provider_spend(t.expenses).select("provider_id", r("risk_pct", 6).alias("pct"))


@query(VIEWS + """, c AS (SELECT project_id, sum(total) AS spent FROM expenses GROUP BY 1)
SELECT p.project_id, CASE WHEN coalesce(spent, 0) <= 0 THEN 'ok' WHEN p.estimate <= 0 THEN 'unbudgeted' WHEN spent / p.estimate < 0.9 THEN 'ok'
  WHEN spent / p.estimate < 1.0 THEN 'tracking' WHEN spent / p.estimate <= 1.1 THEN 'tight' ELSE 'over' END AS cost_status FROM projects p LEFT JOIN c USING (project_id)""")
def phase_cost_status(t) -> DataFrame:
    spent, est = F.coalesce("spent", F.lit(0.0)), F.col("estimate")
    used = spent / F.when(est > 0, est)
    status = F.when(spent <= 0, "ok").when(est <= 0, "unbudgeted").when(used < 0.9, "ok").when(used < 1.0, "tracking").when(used <= 1.1, "tight").otherwise("over")
    c = t.expenses.groupBy("project_id").agg(F.sum("total").alias("spent"))
    return t.projects.join(c, "project_id", "left").select("project_id", status.alias("cost_status"))
