"""Line deduplication over range-partitioned hashes, with keep bitmaps per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import arrow_schema, as_batch, as_bytes, bounded_batches, discard, map_rows, store, unused

BLANKS = b" \t\n\x0b\x0c\r"
DECIDED = "kind int, h1 long, h2 long, doc_id long, version long, pos int, n_docs long"
DROP, PENDING, SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points; only lengths that bytes leave open are decoded."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(text: bytes, least: int) -> Iterator[tuple[int, int, int]]:
    """(position, two halves of a 128-bit hash) of the lines whose key is long enough."""
    for pos, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if long_enough(key, least):
            h = xxhash.xxh3_128_intdigest(key)
            yield pos, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def decide(hashes: DataFrame, min_docs: int) -> DataFrame:
    """Rows (DECIDED) for the lines to drop, from line hashes in any order.

    Hashes are dealt out by ranges of (hash, document), so that a line which very many documents hold
    spreads over many tasks, and sorted by hash, document (largest first) and position. Each task streams
    its rows: the first document of a hash is the one that keeps it, and once ``min_docs`` documents are
    seen, the lines of all others go. Only the first and the last hash of a task may go on in a
    neighbouring task: of these it returns a summary and the lines that it cannot decide on.
    """
    bounded_batches(hashes.sparkSession)
    target = arrow_schema(hashes.sparkSession, DECIDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, first = None, True
        n_docs, keeper, doc, waiting = 0, 0, 0, []

        def close(last: bool) -> None:
            if now is not None and (first or last):
                out.append((SUMMARY, *now, keeper, 0, 0, n_docs))
                out.extend((PENDING, *now, *w, 0) for w in waiting)

        for batch in batches:
            for h1, h2, doc_id, version, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (h1, h2):
                    close(False)
                    first = now is None
                    now, n_docs, keeper, doc, waiting = (h1, h2), 1, doc_id, doc_id, []
                elif doc != doc_id:
                    n_docs, doc = n_docs + 1, doc_id
                if first:  # the document that keeps it may be in the task before
                    out.append((PENDING, h1, h2, doc_id, version, pos, 0))
                elif doc_id != keeper:
                    waiting.append((doc_id, version, pos))
                    if n_docs >= min_docs:
                        out.extend((DROP, h1, h2, *w, 0) for w in waiting)
                        waiting = []
                if len(out) >= 8192:
                    yield as_batch(out, target)
                    out = []
        close(True)
        if out:
            yield as_batch(out, target)

    dealt = hashes.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "version", "pos")
    return dealt.select("h1", "h2", "doc_id", "version", "pos").mapInArrow(run, DECIDED)


def _pack(positions: pd.Series) -> pd.Series:
    def one(gone: np.ndarray) -> bytes:
        bits = np.ones((int(max(gone)) // 8 + 1) * 8, dtype=np.uint8)  # whole bytes: lines beyond stay
        bits[np.asarray(gone, dtype=np.int64)] = 0
        return zlib.compress(np.packbits(bits).tobytes(), 6)

    return positions.map(one)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, version, keep, n_dropped) for the documents that lose lines.

    ``keep`` is a zlib-compressed bitmap, a bit per line up to the last one dropped, 1 if it stays.
    ``version`` is a hash of the text, which tells rows that share an id apart.
    """
    rows = docs.where(F.col(id_col).isNotNull())
    columns = {"doc_id": F.col(id_col).cast("long"), "version": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "text": as_bytes(text_col)}

    def hashed(_: object, doc_id: int, version: int, text: bytes) -> Iterator[tuple]:
        return ((h1, h2, doc_id, version, pos) for pos, h1, h2 in line_hashes(text, min_chars))

    hashes = store(map_rows(rows, columns, hashed, "h1 long, h2 long, doc_id long, version long, pos int"), "lines")
    decided = store(decide(hashes, min_docs), "decided")
    discard(hashes)
    # at most two hashes for each task of the step above
    open_runs = F.broadcast(
        decided.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.sum("n_docs").alias("total")).where(F.col("total") >= min_docs)
    )
    late = decided.where(F.col("kind") == PENDING).join(open_runs, ["h1", "h2"]).where("doc_id <> keeper")
    gone = decided.where(F.col("kind") == DROP).select("doc_id", "version", "pos").unionByName(late.select("doc_id", "version", "pos"))
    pack = F.pandas_udf(_pack, "binary")
    lines = gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))
    return lines.select("doc_id", "version", pack("gone").alias("keep"), F.size("gone").cast("long").alias("n_dropped"))


def apply_bitmap(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return b"\n".join(line for i, line in enumerate(lines) if i not in gone)


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that its bitmap marks as dropped."""

    def run(texts: pd.Series, keeps: pd.Series) -> pd.Series:
        return pd.Series([apply_bitmap(t, k) for t, k in zip(texts, keeps)], dtype=object)

    return F.when(keep.isNull(), text).otherwise(F.pandas_udf(run, "binary")(text.cast("binary"), keep).cast("string"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and columns n_lines, n_dropped, keep.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of ``min_chars`` code
    points or more that occur in ``min_docs`` documents or more lose all their lines but those of the
    largest id. A null text counts as one empty line and becomes empty; rows whose id is null keep all lines
    and count for nothing; rows that share an id are one document, each keeping or losing its own lines.
    A ``docs`` column named n_lines, n_dropped or keep is replaced. An empty table gives an empty result.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    base = docs.drop("n_lines", "n_dropped", "keep")
    own_id, version, keep, n = unused(base, "_id", "_version", "_keep", "_n")
    maps = maps.select(F.col("doc_id").alias(own_id), F.col("version").alias(version), F.col("keep").alias(keep), F.col("n_dropped").alias(n))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = base.join(maps, (F.col(id_col).cast("long") == F.col(own_id)) & (F.xxhash64(text) == F.col(version)), "left")
    out = [kept_text(text, F.col(keep)).alias(c) if c == text_col else F.col(c) for c in base.columns]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(*out, n_lines.alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped"), F.col(keep).alias("keep"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines dropped from each document and the digest of what stays."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The contract of op7 in DuckDB's SQL.
OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
spread AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT y.doc_id, y.pos, y.line, s.k IS NOT NULL AND y.doc_id <> s.keeper AS gone FROM keyed y LEFT JOIN spread s ON y.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
