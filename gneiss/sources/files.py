"""Folders of text files, written, listed and read by tasks through Arrow's file systems (local, HDFS, S3, GCS, Azure).

Spark's own writer makes a folder for each value of a column, and its listing passes every file through the driver; on a
local disk each of these starts a process for its rights besides. Here the driver sees the folders alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the files of a folder are dealt over; files or bytes that a task hands on at once.
PARTS, FILES_AT_ONCE, BYTES_AT_ONCE = 256, 1000, 8 << 20


def _store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return stores.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _escaped(name: str | None) -> str:
    """A name as a file's name, null told apart from empty."""
    return "~" if name is None else "=" + quote(name, safe=" !#$&'()+,-.;=@[]^_`{}~" + "".join(sorted({c for c in name if ord(c) > 127})))


def _plain(name: str) -> str | None:
    return None if name == "~" else unquote(name[1:])


def write_files(texts: DataFrame, path: str) -> None:
    """Each row (folder, name, text) as a file of its own, a line end after its text, in a part of its folder below ``path``.

    Names are told apart by the rows; two rows with one name become two files of it. Rows are dealt by folder and part, so a
    task writes its files one after the other, and writes the same ones if it runs again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        now, made, n = None, None, 0
        for batch in batches:
            for folder, part, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                n = n + 1 if now == (folder, name) else 0
                now, place = (folder, name), f"{base}/{_escaped(folder)}/{part}"
                if place != made:
                    store.create_dir(place, recursive=True)
                    made = place
                with store.open_output_stream(f"{place}/{n}{_escaped(name)}") as out:
                    out.write(f"{text or ''}\n".encode())
        yield from ()

    rows = texts.select("folder", F.pmod(F.xxhash64("name"), F.lit(PARTS)).alias("part"), "name", "text")
    dealt = rows.repartition("folder", "part").sortWithinPartitions("folder", "part", "name", "text")
    dealt.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, place) of the parts of all folders, a few to a task."""
    store, base = _store(path)
    below = lambda place: [x for x in store.get_file_info(stores.FileSelector(place, allow_not_found=True)) if x.type == stores.FileType.Directory]
    found = [(_plain(folder.base_name), part.path) for folder in below(base) for part in below(folder.path)]
    return spark.createDataFrame(found, "folder string, place string").repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)))


def _files(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    store, _ = _store(path)
    for batch in batches:
        for folder, place in zip(*(c.to_pylist() for c in batch.columns)):
            for info in store.get_file_info(stores.FileSelector(place)):
                yield folder, _plain(info.base_name.lstrip("0123456789")), info


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, path, size, modified) of every file below ``path``; no file is opened."""
    kinds = pa.schema([("folder", pa.string()), ("name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for folder, name, info in _files(path, batches):
            rows.append((folder, name, info.path, info.size, info.mtime.astimezone(timezone.utc)))
            if len(rows) == FILES_AT_ONCE:
                yield _batch(rows, kinds)
                rows = []
        if rows:
            yield _batch(rows, kinds)

    return _parts(spark, path).mapInArrow(listed, "folder string, name string, path string, size bigint, modified timestamp")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, size, text) of every file below ``path``; the line end after the last line is no part of a text."""
    kinds = pa.schema([("folder", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        rows, held = [], 0
        for folder, name, info in _files(path, batches):
            with store.open_input_stream(info.path) as file:
                rows.append((folder, name, info.size, file.read().decode(errors="replace").removesuffix("\n")))
            held += info.size
            if len(rows) == FILES_AT_ONCE or held >= BYTES_AT_ONCE:
                yield _batch(rows, kinds)
                rows, held = [], 0
        if rows:
            yield _batch(rows, kinds)

    return _parts(spark, path).mapInArrow(read, "folder string, name string, size bigint, text string")


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
