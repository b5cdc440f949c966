"""Helpers that the corpus operators share: scratch tables, text transfer, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One Arrow batch to a Python worker holds at most so many rows and bytes, so that
#: a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in on a local master; on a cluster, whose executors could
    not see it, it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/gneiss-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``store`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._gneiss_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; a smaller setting of the user's own is kept."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{key}") or "")
        if not 0 < int(now or 0) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def map_texts(
    docs: DataFrame,
    columns: dict[str, Column],
    row: Callable[..., tuple],
    schema: str,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """One output row for each input row: ``row(state, *values)`` runs in Arrow batches.

    ``columns`` are the values handed over (binary columns arrive as bytes); ``setup`` makes ``state``
    once in each task.
    """
    return map_rows(docs, columns, lambda state, *values: (row(state, *values),), schema, setup)


def map_rows(
    docs: DataFrame,
    columns: dict[str, Column],
    rows: Callable[..., Iterable[tuple]],
    schema: str,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """As ``map_texts``, with any number of output rows for an input row; output flows in bounded batches."""
    bounded_batches(docs.sparkSession)
    target = arrow_schema(docs.sparkSession, schema)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(batch.column(n).to_pylist() for n in names)):
                out.extend(rows(state, *values))
                if len(out) >= 8192:
                    yield as_batch(out, target)
                    out = []
            if out:
                yield as_batch(out, target)

    return docs.select(*(c.alias(n) for n, c in columns.items())).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as make it no column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def as_bytes(column: str | Column) -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary")


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``: the fold that a document belongs to."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % of


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node reachable.

    Alternates the large-star and small-star steps, each an aggregation (with map-side combine, so a node
    with very many neighbours is no hot task) and a join that adaptive execution may split. Edges are
    written to the scratch folder between rounds; only two numbers a round come to the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    now, last = store(pairs, "edges"), None
    mark = _mark(now)
    while mark != last:
        last = mark
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(low, "v").where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = store(small.union(low.select("v", F.col("m").alias("u"))).distinct(), "edges")
        discard(now)
        now, mark = after, _mark(after)
    roots = now.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    # bit-xor of row hashes: an order-free digest that cannot overflow
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first())
