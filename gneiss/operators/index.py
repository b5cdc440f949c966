"""An inverted-file index of vectors: rows lie in lists around centres, and a query looks into the nearest lists alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.joins import nearest

#: Centres are fitted on so many rows at most, and there are no more of them than fit into a task beside its rows.
SAMPLE_ROWS, MOST_LISTS = 50_000, 4096


class VectorIndex:
    """Centres of unit vectors, fitted on a bounded sample; every row is in the list of its nearest centre.

    Rows without a vector, or with one of no length, are in list -1, which every query looks into. ``nearest`` is exact within
    the lists that are looked into; with all of them it is brute force.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @classmethod
    def fit(cls, rows: DataFrame, vector: str = "embedding", lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> VectorIndex:
        """Fit on ``sample_rows`` rows by a hash of the vector; about as many lists as the root of all rows, if not given."""
        known = rows.where(_length(F.col(vector)) > 0)
        n = known.count()
        lists = max(1, min(MOST_LISTS, round(n**0.5) if lists is None else lists))
        if not n:
            return cls(np.zeros((0, 1)))
        sample = known.select(F.col(vector).cast("array<double>").alias("v"))
        if n > sample_rows:
            sample = sample.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
        unit = sample.select(array_to_vector(F.transform("v", lambda x: x / _length(F.col("v")))).alias("features"))
        centres = np.array(KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(unit).clusterCenters())
        return cls(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12))

    def _nearest_lists(self, vector: Column, k: int) -> Column:
        """The ``k`` lists whose centres are most like a vector, nearest first, as an array."""
        centres = self.centres

        def run(vectors: pd.Series) -> pd.Series:
            out = []
            for v in vectors:
                v = None if v is None else np.asarray(v, dtype=np.float64)
                if v is None or not len(centres) or not np.nansum(v * v) > 0:
                    out.append(None)
                else:
                    out.append(np.argsort(-(centres @ v), kind="stable")[:k].astype(np.int32))
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, "array<int>")(vector.cast("array<double>"))

    def indexed(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """All ``rows`` with their list in ``_list``; written by list, a query's lists are found by folder."""
        return rows.withColumn("_list", F.coalesce(F.get(self._nearest_lists(F.col(vector), 1), F.lit(0)), F.lit(-1)))

    def nearest(self, queries: DataFrame, indexed: DataFrame, k: int, query_id: str, row_id: str, vector: str = "embedding", probes: int = 8) -> DataFrame:
        """As ``joins.nearest``, over the ``probes`` nearest lists of each query; all lists for a query without a length."""
        everything = F.array(F.lit(-1), *map(F.lit, range(len(self.centres))))
        looked = F.coalesce(F.array_prepend(self._nearest_lists(F.col(vector), probes), F.lit(-1)), everything)
        return nearest(queries.withColumn("_lists", looked), indexed, k, query_id, row_id, vector)


def _length(v: Column) -> Column:
    return F.coalesce(F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)) * F.coalesce(x, F.lit(0.0)))), F.lit(0.0))
