"""Parquet tables in parts, each version a manifest that lists the folders of every part.

A writer adds folders and then a manifest; a reader takes the newest manifest and keeps to its folders, so neither
waits for the other. One writer at a time, as a stream's batches are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that names the part of a row in the files.
PART = "_part"


class PartedTable:
    """``versions()``, ``read()`` and what writers share; ``path`` may be in any store that Spark reaches."""

    #: Whether folders may have other columns than each other.
    widens = False

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place = self._hadoop(f"{self.path}/_manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, or else the newest: ``parts`` (part to folders) and ``batch``, the last one taken in."""
        have = self.versions()
        if not have:
            return {"parts": {}, "batch": -1}
        stream = self._fs.open(self._hadoop(f"{self.path}/_manifests/{have[-1] if version is None else version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        folders = sorted({f for own in self.manifest(version)["parts"].values() for f in own})
        if not folders:
            raise ValueError(f"{self.path} has no rows")
        return self._folders(folders)

    def _folders(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", self.widens).parquet(*(f"{self.path}/{f}" for f in folders))

    def _write(self, rows: DataFrame, part: Column) -> dict[str, list[str]]:
        """Rows in a folder of their own for each part; (part, folders)."""
        own = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, part).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{own}")
        listed = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"{self.path}/{own}"))]
        return {n.partition("=")[2]: [f"{own}/{n}"] for n in listed if n.startswith(f"{PART}=")}

    def _commit(self, manifest: dict) -> None:
        version = (self.versions() or [-1])[-1] + 1
        draft, final = (self._hadoop(f"{self.path}/_manifests/{n}") for n in (f".{uuid.uuid4().hex}", version))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise ValueError(f"{self.path} got version {version} from another writer")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest ``keep``, and the folders that none of these lists; the folders deleted."""
        have = self.versions()
        listed = lambda versions: {f for v in versions for own in self.manifest(v)["parts"].values() for f in own}
        old, stay = have[:-keep], listed(have[-keep:])
        gone = sorted(listed(old) - stay)
        for folder in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)
        for version in old:
            self._fs.delete(self._hadoop(f"{self.path}/_manifests/{version}"), False)
        return gone


class KeyedTable(PartedTable):
    """One row a key, in ``buckets`` parts by a hash of it: a batch rewrites those parts alone that it touches."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64, merge: bool = False):
        super().__init__(spark, path)
        self.key, self.order, self.buckets, self.merge = key, order, buckets, merge
        self.widens = merge

    def upsert(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Take in the rows of a batch; the parts that were rewritten.

        Of a key the row with the largest ``order`` stays, ties go to the larger values. With ``merge`` each value of the batch
        (of several the one with the largest ``order``) takes the place of what stands there, and a null or a column that
        the batch lacks leaves it. A batch that was taken in before changes nothing; one that leaves out its predecessor
        is an error.
        """
        now = self.manifest()
        if batch_id <= now["batch"]:
            return []
        if batch_id != now["batch"] + 1:
            raise ValueError(f"{self.path} has batches up to {now['batch']}, so {batch_id} leaves some out")
        batch.persist()
        try:
            part = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
            touched = [str(r[0]) for r in batch.select(part).distinct().collect()]  # as many as there are buckets at most
            old = sorted({f for p in touched for f in now["parts"].get(p, [])})
            fresh = batch.withColumn("_fresh", F.lit(1))
            rows = fresh.unionByName(self._folders(old).withColumn("_fresh", F.lit(0)), allowMissingColumns=True) if old else fresh
            values = [c for c in rows.columns if c not in (self.key, "_fresh")]
            rank = F.struct(self.order, *(c for c in values if c != self.order))
            if self.merge:
                latest = F.struct("_fresh", rank)
                newest = rows.groupBy(self.key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), latest)).alias(c) for c in values))
            else:
                newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*values), rank).alias("_r")).select(self.key, "_r.*")
            written = self._write(newest, part) if touched else {}
        finally:
            batch.unpersist()
        self._commit({"parts": now["parts"] | written, "batch": batch_id})
        return sorted(written)

    def sink(self):
        """A function for ``foreachBatch``."""
        return lambda batch, batch_id: self.upsert(batch, batch_id)


class HourlyLog(PartedTable):
    """Rows that are only added, in parts by the hour of ``at``, which expire as a whole."""

    def __init__(self, spark: SparkSession, path: str, at: str = "ts"):
        super().__init__(spark, path)
        self.at = at

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, once; rows without a time are an error in the making and stay in a part of their own."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return
        hour = F.coalesce(F.date_format(self.at, "yyyyMMddHH"), F.lit("none"))
        parts = dict(now["parts"])
        for part, folders in self._write(batch, hour).items():
            parts[part] = parts.get(part, []) + folders
        self._commit({"parts": parts, "batch": batch_id})

    def expire(self, as_of: str, hours: int) -> list[str]:
        """Drop the parts all of whose rows are ``hours`` old at a time; the parts. Rows of an hour that is partly expired stay."""
        now = self.manifest()
        limit = self.spark.range(1).select(F.date_format(F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours + 1)), "yyyyMMddHH")).first()[0]
        gone = sorted(p for p in now["parts"] if p <= limit)
        if gone:
            self._commit({"parts": {p: f for p, f in now["parts"].items() if p not in gone}, "batch": now["batch"]})
        return gone
