"""Joins whose kind depends on the data or on the order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The queries that one pass over the rows compares have so many bytes of vectors.
BLOCK_BYTES = 64 << 20
#: Scores that a task works out at once: those of some queries and one batch of rows.
PRODUCT_BYTES = 64 << 20


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 where either has no length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def _unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of length 1 as rows, zeros for none."""
    flat = vectors.flatten()
    if not vectors.null_count and not flat.null_count and len(flat) == len(vectors) * width:
        out = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    else:
        out = np.array([v if v is not None else [0.0] * width for v in vectors.to_pylist()], dtype=np.float64).reshape(-1, width)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


class _Best:
    """The best ``k`` rows of each of many queries so far, as they stream by."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, dtype=object)] * n
        self.least = np.full(n, -np.inf)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each of ``queries`` and a column for each of ``ids``; ties go to the smaller id."""
        for at in np.flatnonzero(scores.max(axis=1) >= self.least[queries]):
            q = queries[at]
            hit = scores[at] >= self.least[q]
            own, named = np.concatenate([self.scores[q], scores[at][hit]]), np.concatenate([self.ids[q], ids[hit]])
            if len(own) > self.k:
                chosen = np.flatnonzero(own >= np.partition(own, len(own) - self.k)[len(own) - self.k])
                if len(chosen) > self.k:
                    chosen = np.array(sorted(chosen.tolist(), key=lambda i: (-own[i], named[i]))[: self.k])
                own, named = own[chosen], named[chosen]
            self.scores[q], self.ids[q] = own, named
            if len(own) == self.k:
                self.least[q] = own.min()


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, row_id, score, rank) of the ``k`` rows most like each query by cosine.

    The queries are a stated set against all rows, by brute force: they go through in blocks of
    ``block_bytes``, each sent to all tasks as a matrix and multiplied with every batch of rows, so many
    queries at a time that a product has no more than ``PRODUCT_BYTES``. A task keeps
    the best ``k`` of each query and returns them at its end, so queries x ``k`` rows a task are shuffled and
    ranked; ties go to the smaller id. A null vector has no length, and so a score of 0. Rows in a ``_list`` meet the
    queries alone whose ``_lists`` name it, where both have such a column.
    """
    listed = "_list" in rows.columns and "_lists" in queries.columns
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"), (F.col("_lists") if listed else F.lit(None).cast("array<int>")).alias("lists"))
    n, width = q.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    kinds = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    schema = f"`{query_id}` {kinds[0]}, `{row_id}` {kinds[1]}, score double"
    target = to_arrow_schema(StructType.fromDDL(schema))
    out = rows.sparkSession.createDataFrame([], schema)
    n_blocks = n * width * 8 // block_bytes + 1
    for block in range(n_blocks):
        part = (q.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block) if n_blocks > 1 else q).collect()
        if not part:
            continue
        probing: dict = {}
        for at, r in enumerate(part):
            for name in (r.lists or ()) if listed else (None,):
                probing.setdefault(name, []).append(at)
        own = {name: np.array(at) for name, at in probing.items()}
        spread = rows.sparkSession.sparkContext.broadcast(([r.q for r in part], _unit(pa.array([r.v for r in part], type=pa.list_(pa.float64())), width), own))

        def best(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            ids, matrix, asking = spread.value
            top = _Best(len(ids), k)
            for batch in batches:
                row_ids, unit = np.array(batch.column(0).to_pylist(), dtype=object), _unit(batch.column(1), width)
                lists = np.array(batch.column(2).to_pylist()) if listed else None
                for name in np.unique(lists).tolist() if listed else (None,):
                    here = np.flatnonzero(lists == name) if listed else slice(None)
                    some, named = unit[here], row_ids[here]
                    at = asking.get(name, np.zeros(0, dtype=np.int64))
                    step = max(1, PRODUCT_BYTES // (8 * max(1, len(some))))
                    for first in range(0, len(at) if len(some) else 0, step):
                        top.add(at[first : first + step], matrix[at[first : first + step]] @ some.T, named)
            for i, scored, named in zip(ids, top.scores, top.ids):
                if len(scored):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(scored), type=target[0].type), pa.array(named.tolist(), type=target[1].type), pa.array(scored)], schema=target)

        read = rows.select(row_id, F.col(vector).cast("array<double>").alias("v"), *(["_list"] if listed else []))
        out = out.unionByName(read.mapInArrow(best, schema))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).where("_first = 1").drop("_first")


def pair_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """One-to-one equi-join: the n-th left row of a key meets the n-th right row of it."""
    l = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    r = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return l.join(r, [*keys, "_n"]).drop("_n")
