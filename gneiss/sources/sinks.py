"""Writers: upserts, replaced children, deletes, CSV, JSON and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batched_write(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def replace_children(df: DataFrame, path: str, parent: str) -> None:
    """Replace the children of the parents that ``df`` has, and no others: one folder for each parent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def delete_where(spark: SparkSession, path: str, out: str, condition: Column) -> None:
    """Copy a table without the rows that meet the condition (null counts as not met)."""
    spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))).write.mode("overwrite").parquet(out)


def update_where(spark: SparkSession, path: str, out: str, condition: Column, **values: Column) -> None:
    """Copy a table with columns set in the rows that meet the condition (null counts as not met)."""
    rows, met = spark.read.parquet(path), F.coalesce(condition, F.lit(False))
    changed = {name: F.when(met, value).otherwise(F.col(name) if name in rows.columns else F.lit(None)) for name, value in values.items()}
    rows.withColumns(changed).write.mode("overwrite").parquet(out)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated, with a header."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def markdown_report(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A table for people to read: the first ``limit`` rows only."""
    rows = df.limit(limit).collect()
    cells = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([f"# {title}", "", cells(df.columns), cells("---" for _ in df.columns), *map(cells, rows)])
