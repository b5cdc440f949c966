"""Aggregations over business frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.sources.scratch import scratch_path


def sum_where(value: Column | str, condition: Column) -> Column:
    """Sum of the rows that meet a condition, 0 for none."""
    return F.coalesce(F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value)), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """``top / bottom``, or ``empty`` where the denominator isn't positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows; the order must break ties."""
    return df.orderBy(*order).limit(n)


def share_of_total(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Each row's per cent of the sum over all rows, joined as one row instead of a one-task window."""
    whole = df.agg(F.sum(value).alias("_whole"))
    return df.crossJoin(F.broadcast(whole)).withColumn(alias, ratio(F.col(value) * 100, F.col("_whole"))).drop("_whole")


def positions(df: DataFrame, *order: Column | str, alias: str = "position") -> DataFrame:
    """Rows with their place in the order of the whole table, from 0, without a one-task window.

    Rows are sorted by ranges and written once; a range's first place is the sum of the sizes of those before.
    """
    path = scratch_path(df.sparkSession, "ordered")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_range").withColumn(alias, place).drop("_range", "_id", "_start")


def percentiles(df: DataFrame, value: str, **shares: tuple[str, float]) -> DataFrame:
    """One row with an exact percentile for each name: ("middle", q) interpolates, ("lower", q) takes the value below.

    Values that are null count for nothing; without any, percentiles are null.
    """
    placed = positions(df.where(F.col(value).isNotNull()).select(value), value)
    n = placed.count()
    wanted = {name: ((n - 1) * q if how == "middle" else (n - 1) * q // 1) for name, (how, q) in shares.items()}
    places = sorted({int(x) + i for x in wanted.values() for i in (0, 1)})
    found = placed.where(F.col("position").isin(*places)).agg(*(F.max(F.when(F.col("position") == p, F.col(value))).alias(f"_{p}") for p in places))
    low = lambda x: F.col(f"_{int(x)}")
    return found.select(*(F.when(F.lit(x == int(x)), low(x)).otherwise(low(x) + (F.col(f"_{int(x) + 1}") - low(x)) * (x - int(x))).alias(name) for name, x in wanted.items()))


def provider_spend(expenses: DataFrame) -> DataFrame:
    """Spend, invoices and distinct projects for each provider, with its share of all spend."""
    per = expenses.groupBy("provider_id").agg(
        F.sum("total").alias("spend"), F.count("*").alias("n_expenses"), F.countDistinct("project_id").alias("n_projects")
    )
    return share_of_total(per, "spend", "risk_pct")
