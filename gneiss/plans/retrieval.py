"""Retrieval of correction fragments for budget lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import chapter_code_of
from gneiss.operators.matching import hybrid_similarity
from gneiss.sources.scratch import stored

#: Prefixes of tags that are no topics.
META_TAGS = ("scope:", "chapter:", "principle:", "multiplier:", "surface_band:", "reason:", "cross_chapter:")


def topics(tags: Column) -> Column:
    """Tags in lower case that say what a fragment is about."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.filter(low, lambda x: ~F.exists(F.array(*map(F.lit, META_TAGS)), lambda p: F.startswith(x, p)))


def tag_values(tags: Column, name: str) -> Column:
    """What follows ``name:`` in the tags that begin with it, in lower case."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    own = F.filter(low, lambda x: F.startswith(x, F.lit(f"{name}:")))
    return F.filter(F.transform(own, lambda x: F.trim(F.substring(x, len(name) + 2, 1 << 30))), lambda x: x != "")


def _grams(text: Column, n: int) -> Column:
    """All pieces of ``n`` characters of a text."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def names_with(names: DataFrame, tags: DataFrame) -> DataFrame:
    """(_name, _tag): names that contain a tag. They meet on the tag's first three characters (or all, of a shorter one)."""
    pieces = F.array_distinct(F.concat(*(_grams(F.col("_name"), n) for n in (1, 2, 3))))
    left = names.select("_name", F.explode(pieces).alias("_gram"))
    right = tags.select("_tag", F.substring("_tag", 1, 3).alias("_gram"))
    return left.join(right, "_gram").where(F.contains("_name", F.col("_tag"))).select("_name", "_tag")


def applying(lines: DataFrame, fragments: DataFrame) -> DataFrame:
    """Rows (line_id, description, fragment_id, _d, rows, is_baseline) of lines and the fragments that apply to them and are not off their topics.

    A fragment applies to all lines if it is tagged ``cross_chapter:true``, to those of its ``chapter_code``,
    and to those whose chapter's name contains its ``chapter``. Lines meet fragments on codes, on distinct chapter names or
    everywhere, and at once on topics; only where one side has no topics do they meet without. Each pair is made once: by the
    first of these ways that holds, at the first topic that both have, so pairs need no sorting out.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    # a side without topics meets every row of the other under a key of its own
    none, both = F.lit("\0"), F.lit("\0\0")
    named = lambda c: F.filter(c, lambda x: x.isNotNull())
    ask = F.when(F.size("topics") > 0, F.concat(named("topics"), F.array(none))).otherwise(F.array(none, both))
    offer = F.when(F.size("_t") > 0, F.concat(named("_t"), F.array(both))).otherwise(F.array(none))
    name = F.lower(F.coalesce("chapter", F.lit(""))).alias("_name")
    asked = lines.where("line_id IS NOT NULL").select("line_id", "description", name, chapter_code_of(F.col("code")).alias("_own"), F.array_distinct(ask).alias("_ask"))
    asked = asked.withColumn("_topic", F.explode("_ask"))
    padded = lambda x: F.lpad(F.ltrim(x, F.lit("0")), F.greatest(F.lit(2), F.length(F.ltrim(x, F.lit("0")))), F.lit("0"))
    offered = fragments.where("fragment_id IS NOT NULL").select(
        "fragment_id", F.trim("description").alias("_d"), "rows", "is_baseline", F.exists(tags, lambda x: F.lower(x) == "cross_chapter:true").alias("_all"), topics(F.col("tags")).alias("_t"),
        F.array_distinct(tag_values(F.col("tags"), "chapter")).alias("_tags"), F.array_distinct(F.transform(tag_values(F.col("tags"), "chapter_code"), padded)).alias("_codes"),
    )
    offered = offered.withColumn("_off", F.array_distinct(offer)).withColumn("_topic", F.explode("_off"))
    here = offered.where(~F.coalesce("_all", F.lit(False)))
    meets = names_with(lines.select(name).distinct(), here.select(F.explode("_tags").alias("_tag")).distinct())
    first = F.array_intersect("_ask", "_off")[0] == F.col("_topic")
    everywhere = asked.join(offered.where("_all"), "_topic").where(first)
    by_code = asked.withColumn("_code", F.col("_own")).join(here.withColumn("_code", F.explode("_codes")), ["_topic", "_code"]).where(first)
    by_name = asked.join(meets, "_name").join(here.withColumn("_tag", F.explode("_tags")), ["_topic", "_tag"]).where(first)
    by_name = by_name.where(~F.coalesce(F.array_contains("_codes", F.coalesce("_own", both)), F.lit(False)))
    by_name = by_name.where(F.filter("_tags", lambda x: F.contains(F.col("_name"), x))[0] == F.col("_tag"))
    pairs = [p.select("line_id", "description", "fragment_id", "_d", "rows", "is_baseline") for p in (by_name, by_code, everywhere)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def _kinds(df: DataFrame, same: list[str], label: str, **about: Column) -> tuple[DataFrame, DataFrame]:
    """(a row for each kind of rows that agree in ``same``, with its number ``_kind``; ``df`` with the number of each row's kind)."""
    keyed = df.withColumn("_same", F.struct(*same))
    kinds = keyed.groupBy("_same").agg(*(c.alias(name) for name, c in about.items())).select("_same", *about, F.monotonically_increasing_id().alias("_kind"))
    kinds = stored(kinds, label)
    return kinds.select("_same.*", *about, "_kind"), keyed.join(kinds.select("_same", "_kind"), "_same")


def retrieve_fragments(
    lines: DataFrame, fragments: DataFrame, as_of, months: int = 12, min_similarity: float = 0.45, min_count: int = 2, top: int | None = None
) -> DataFrame:
    """(line_id, fragment_id, similarity, rank): golden fragments that are recent, apply, on topic and alike.

    ``lines`` has (line_id, code, chapter, description, topics), ``fragments`` (fragment_id, status, tags,
    description, at, is_baseline). A line with fewer than ``min_count`` fragments gets none, unless one of
    them is a baseline. Null topics are none. All are returned in order of likeness, or the first ``top``. Lines that differ
    in their ids alone, and fragments of one text and the same tags, are met, compared and counted once; their rows come in at the end.
    """
    lines = lines.where("line_id IS NOT NULL AND description IS NOT NULL").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    lines = lines.withColumn("_name", F.lower(F.coalesce("chapter", F.lit("")))).withColumn("_own", chapter_code_of(F.col("code")))
    asking, asked = _kinds(lines, ["description", "_name", "_own", "topics"], "lines", code=F.min("code"), chapter=F.min("chapter"))
    recent = fragments.where((F.col("status") == "golden") & (F.col("at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(30 * months))))
    recent = recent.where("fragment_id IS NOT NULL").withColumn("description", F.trim(F.coalesce("description", F.lit("")))).where("description <> ''")
    offering, offered = _kinds(recent, ["description", "tags"], "fragments", rows=F.count("*"), is_baseline=F.max("is_baseline"))
    pairs = stored(applying(asking.withColumnRenamed("_kind", "line_id"), offering.withColumnRenamed("_kind", "fragment_id")), "pairs")
    # each pair of texts is compared once, however many rows have them; stored, as the filter would else move below
    texts = pairs.select("description", "_d").distinct()
    compared = texts.repartition(8 * lines.sparkSession.sparkContext.defaultParallelism).withColumn("similarity", hybrid_similarity(F.col("description"), F.col("_d")))
    alike = pairs.join(stored(compared, "compared").where(F.col("similarity") >= min_similarity), ["description", "_d"])
    by = Window.partitionBy("line_id")
    counted = alike.withColumn("_n", F.sum("rows").over(by)).withColumn("_base", F.max(F.col("is_baseline").cast("int")).over(by))
    enough = counted.where((F.col("_n") >= min_count) | (F.col("_base") == 1)).select(F.col("line_id").alias("_line"), F.col("fragment_id").alias("_kind"), "similarity")
    found = enough.join(offered.select("_kind", "fragment_id", "at"), "_kind")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_line").orderBy(F.desc("similarity"), F.desc("at"), "fragment_id")))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(asked.select(F.col("_kind").alias("_line"), "line_id"), "_line").select("line_id", "fragment_id", "similarity", "rank")
