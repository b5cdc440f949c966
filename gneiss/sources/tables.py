"""Tables of one folder, read when asked for, and the business views made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """``tables.orders`` is the Parquet table ``orders`` of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        """Events, their time as an instant (files hold it without a zone)."""
        return self.spark.read.parquet(f"{self.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def expenses(self) -> DataFrame:
        """Invoice lines: lineitem with its net total; a finished line counts as validated."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("project_id"),
            F.col("l_suppkey").alias("provider_id"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_linenumber").alias("line_no"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_tax")).alias("tax_amount"),
            F.when(F.col("l_linestatus") == "F", "validada").otherwise("pendiente").alias("status"),
            F.col("l_shipdate").alias("invoice_date"),
        )

    @property
    def projects(self) -> DataFrame:
        """Projects: orders, their price as the estimate."""
        status = F.when(F.col("o_orderstatus") == "F", "completado").when(F.col("o_orderstatus") == "O", "ejecucion").otherwise("preparacion")
        return self.orders.select(
            F.col("o_orderkey").alias("project_id"),
            F.col("o_custkey").alias("client_id"),
            F.col("o_totalprice").alias("estimate"),
            status.alias("status"),
            F.col("o_orderdate").alias("start_date"),
            F.col("o_orderpriority").alias("priority"),
        )

    @property
    def chapters(self) -> DataFrame:
        """Chapter of each part: its type."""
        return self.part.select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("chapter"))


#: The same views in SQL, to stand at the head of a query.
EXPENSES_SQL = """expenses AS (
  SELECT l_orderkey AS project_id, l_suppkey AS provider_id, l_partkey AS part_id, l_linenumber AS line_no,
         l_extendedprice * (1 - l_discount) AS total, l_extendedprice * (1 - l_discount) * l_tax AS tax_amount,
         CASE WHEN l_linestatus = 'F' THEN 'validada' ELSE 'pendiente' END AS status, l_shipdate AS invoice_date
  FROM lineitem)"""
PROJECTS_SQL = """projects AS (
  SELECT o_orderkey AS project_id, o_custkey AS client_id, o_totalprice AS estimate,
         CASE o_orderstatus WHEN 'F' THEN 'completado' WHEN 'O' THEN 'ejecucion' ELSE 'preparacion' END AS status,
         o_orderdate AS start_date, o_orderpriority AS priority
  FROM orders)"""
CHAPTERS_SQL = "chapters AS (SELECT p_partkey AS part_id, p_type AS chapter FROM part)"
