"""Prices for budget lines: candidates from a catalog, reranked, tiered, grouped, and ancillary lines in a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import budget
from gneiss.operators.joins import nearest
from gneiss.operators.ordered import grouped_runs

#: Candidates that a line keeps, and how many times as many neighbours are looked at for them.
CANDIDATES, OVERSAMPLE = 15, 3
#: A candidate of another dimension than the line's counts for so much.
OTHER_DIMENSION = 0.3
#: What ancillary lines cost, as a share of the other lines of their budget and chapter.
ANCILLARY_SHARE = 0.02
#: So few candidates are not put in another order; the chapter of lines without one.
FEW, NO_CHAPTER = 3, "Sin Capítulo"


def candidates(lines: DataFrame, catalog: DataFrame, keep: int = CANDIDATES) -> DataFrame:
    """(line_id, item_id, score, rank): a line's best items, one for each code, by cosine, keywords and dimension.

    ``lines`` has (line_id, embedding, keywords, dimension), ``catalog`` (item_id, code, embedding, words,
    dimension). A score grows by up to a half with the share of keywords that the item has.
    """
    near = nearest(lines, catalog, OVERSAMPLE * keep, "line_id", "item_id").select("line_id", "item_id", F.col("score").alias("_cosine"))
    items = catalog.select("item_id", "code", "words", F.col("dimension").alias("_dimension"))
    rows = near.join(items, "item_id").join(lines.select("line_id", "keywords", "dimension"), "line_id")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("keywords", "words")), F.size(F.array_distinct("keywords"))), F.lit(0.0))
    penalty = F.when(F.col("dimension") != F.col("_dimension"), OTHER_DIMENSION).otherwise(1.0)
    scored = rows.withColumn("score", F.col("_cosine") * (1 + 0.5 * share) * penalty)
    by_code = Window.partitionBy("line_id", "code").orderBy(F.desc("score"), "item_id")
    once = scored.withColumn("_n", F.row_number().over(by_code)).where("_n = 1")
    best = Window.partitionBy("line_id").orderBy(F.desc("score"), "item_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("line_id", "item_id", "score", "rank")


def reranked(found: DataFrame, selected: DataFrame) -> DataFrame:
    """``found`` (of ``candidates``) with the chosen items first: of a line with over three candidates those that ``selected`` names, in its order.

    ``selected`` has (line_id, ids), as a model chose them; ids that are no candidates are left out, and a line without any that is
    keeps its candidates.
    """
    n = F.count("*").over(Window.partitionBy("line_id"))
    rows = found.join(selected.select("line_id", "ids"), "line_id", "left").withColumn("_n", n)
    place = F.when(F.col("_n") > FEW, F.nullif(F.array_position("ids", F.col("item_id")), F.lit(0)))
    rows = rows.withColumn("_place", place).withColumn("_any", F.max("_place").over(Window.partitionBy("line_id")).isNotNull())
    order = Window.partitionBy("line_id").orderBy(F.coalesce("_place", "rank"))
    return rows.where("_place IS NOT NULL OR NOT _any").select("line_id", "item_id", "score", F.row_number().over(order).alias("rank"))


def price_lines(lines: DataFrame, catalog: DataFrame, valuations: DataFrame | None = None, selected: DataFrame | None = None, done: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(line_id, budget_id, item_id, tier, escalated, match_kind, group_id, unit_price, total, needs_review, confidence) of every line.

    ``lines`` has besides the columns for ``candidates`` (budget_id, seq, chapter, description, unit, quantity), ``catalog`` (unit,
    price). Lines in ``done`` (rows of an earlier run) are taken over as they are. Of the others the best candidate's
    score and unit decide the tier, after ``selected`` has put candidates in another order. A line takes the price of
    its tier's row of ``valuations`` (line_id, tier, match_kind, needs_review, unit_price); where the quick one is from scratch or
    to be reviewed, that of ``pro``, if there is one. Without a valuation it takes its candidate's price, which is null without
    a candidate. Easy lines that follow each other in a chapter are grouped. Ancillary lines cost a share of what the other
    lines of their budget and chapter cost, in a second pass. Null quantities count as 0, units as ud, chapters as
    ``NO_CHAPTER``; lines in common units over 100,000 are to be reviewed. ``found``: candidates that are known already.
    """
    lines = lines.withColumns({"quantity": F.coalesce("quantity", F.lit(0.0)), "unit": F.coalesce("unit", F.lit("ud")), "chapter": F.coalesce("chapter", F.lit(NO_CHAPTER)), "description": F.coalesce("description", F.lit(""))})
    if done is not None:
        lines = lines.join(done.select("line_id"), "line_id", "left_anti")
    found = candidates(lines, catalog) if found is None else found
    best = (found if selected is None else reranked(found, selected)).where("rank = 1").select("line_id", "item_id", "score")
    items = catalog.select("item_id", F.col("unit").alias("_unit"), "price")
    rows = lines.drop("embedding", "keywords").join(best, "line_id", "left").join(items, "item_id", "left")
    rows = rows.withColumn("ancillary", budget.is_ancillary(F.col("description"))).withColumn("tier", budget.select_tier(F.col("score"), F.col("_unit"), F.col("unit")))
    rows = grouped_runs(rows.withColumn("_easy", F.col("tier") == "flash"), ["budget_id"], "seq", "_easy", "chapter")
    if valuations is None:
        rows = rows.withColumns({"_flash": F.lit(None).cast("struct<match_kind:string,needs_review:boolean,unit_price:double>")}).withColumn("_pro", F.col("_flash"))
    else:
        value = F.struct("match_kind", F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.col("unit_price").cast("double").alias("unit_price"))
        of = lambda tier: F.max(F.when(F.col("tier") == tier, value)).alias(f"_{tier}")
        rows = rows.join(valuations.groupBy("line_id").agg(of("flash"), of("pro")), "line_id", "left")
    again = budget.needs_pro(F.col("tier"), F.col("_flash.match_kind"), F.col("_flash.needs_review")) & F.col("_pro").isNotNull()
    chosen = F.when((F.col("tier") == "pro") | again, F.col("_pro")).otherwise(F.col("_flash"))
    rows = rows.withColumn("escalated", again).withColumn("_v", chosen).withColumn("_price", F.coalesce("_v.unit_price", "price"))
    own = F.when(~F.col("ancillary"), F.col("quantity") * F.col("_price"))
    base = F.coalesce(F.sum(own).over(Window.partitionBy("budget_id", "chapter")), F.lit(0.0))
    unit_price = F.when(F.col("ancillary"), F.lit(ANCILLARY_SHARE) * F.col("_base")).otherwise(F.col("_price"))
    total = F.when(F.col("ancillary"), F.col("unit_price")).otherwise(F.col("quantity") * F.col("_price"))
    priced = rows.withColumn("_base", base).withColumn("unit_price", unit_price).withColumn("total", total)
    review = F.coalesce("_v.needs_review", F.lit(False)) | budget.runaway(F.col("unit"), F.col("unit_price"), F.col("quantity"))
    out = priced.withColumn("needs_review", review).select(
        "line_id", "budget_id", "item_id", "tier", "escalated", F.coalesce("_v.match_kind", F.when(F.col("item_id").isNotNull(), "1:1")).alias("match_kind"), "group_id", "unit_price", "total",
        "needs_review", F.when(F.col("needs_review"), 40).otherwise(95).alias("confidence"),
    )
    return out if done is None else out.unionByName(done.select(out.columns))


#: Overhead, benefit and tax of a finished budget in per cent; the chapter of tasks without one.
OVERHEAD_PCT, BENEFIT_PCT, TAX_PCT, OTHER_CHAPTER = 10.0, 15.0, 21.0, "VARIOS"


def finished_budgets(tasks: DataFrame) -> DataFrame:
    """(budget_id, chapters, execution, overhead, benefit, tax, total) of priced tasks (budget_id, seq, chapter, unit_price, quantity).

    Prices are marked up to the cent, task by task; ``chapters`` are structs (order, name, n_items, total) in the order in which the
    tasks name them. The costs of execution are what the marked-up sum comes to without the markup. Null prices count as 0.
    """
    factor = budget.markup_factor(F.lit(OVERHEAD_PCT), F.lit(BENEFIT_PCT))
    name = F.coalesce(F.nullif(F.trim("chapter"), F.lit("")), F.lit(OTHER_CHAPTER))
    unit = F.round(F.coalesce("unit_price", F.lit(0.0)) * factor, 2)
    rows = tasks.select("budget_id", "seq", name.alias("name"), F.round(unit * F.coalesce("quantity", F.lit(0.0)), 2).alias("total"))
    chapters = rows.groupBy("budget_id", "name").agg(F.min("seq").alias("first"), F.count("*").alias("n_items"), F.sum("total").alias("total"))
    listed = chapters.groupBy("budget_id").agg(F.sort_array(F.collect_list(F.struct("first", "name", "n_items", "total"))).alias("c"), F.sum("total").alias("s"))
    entry = lambda x, i: F.struct((i + 1).alias("order"), x["name"].alias("name"), x["n_items"].alias("n_items"), x["total"].alias("total"))
    raw = F.col("s") / factor
    tax = F.round(F.col("s") * (TAX_PCT / 100), 2)
    return listed.select(
        "budget_id", F.transform("c", entry).alias("chapters"), F.round(raw, 2).alias("execution"), F.round(raw * (OVERHEAD_PCT / 100), 2).alias("overhead"),
        F.round(raw * (BENEFIT_PCT / 100), 2).alias("benefit"), tax.alias("tax"), F.round(F.col("s") + tax, 2).alias("total"),
    )


def mode_total(mode: Column, total: Column, quantity: Column, parts: Column) -> Column:
    """What an item costs in a mode: ``execution`` leaves out its variable components, ``labor`` has labour alone; never below 0.

    ``parts`` are components (code, is_variable, total) of one piece; an item without any costs its total in every mode. A null or
    zero quantity counts as one.
    """
    pieces = F.coalesce(F.nullif(quantity.cast("double"), F.lit(0.0)), F.lit(1.0))
    cost = lambda keep: F.aggregate(F.filter(parts, keep), F.lit(0.0), lambda s, p: s + F.coalesce(p["total"], F.lit(0.0))) * pieces
    whole = F.coalesce(total, F.lit(0.0))
    variable, labor = cost(lambda p: F.coalesce(p["is_variable"], F.lit(False))), cost(lambda p: F.startswith(F.lower(p["code"]), F.lit("mo")))
    own = F.when(mode == "execution", F.greatest(F.lit(0.0), whole - variable)).when(mode == "labor", F.greatest(F.lit(0.0), labor)).otherwise(whole)
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, own).otherwise(whole)
