"""Filter interaction audit: failure masks, duplicates by sorting, counters of every order of the filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import arrow_schema, as_batch, as_bytes, bounded_batches, discard, map_rows, map_texts, store

#: The filters, each a bit of a mask in this order; E, the last, compares documents with each other.
FILTERS = "ABCDE"
SHORT, DISTINCT_SHARE, CAPITAL_SHARE, SIGNS = 200, 50, 2, b"#$%&*|"
REPEATED = 1 << FILTERS.index("E")

ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CAPITALS, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_DECIDED, _PENDING, _SUMMARY = 0, 1, 2
_ROWS = "kind int, doc_id long, part string, mask int, fp long, digest binary"


def own_failures(text: bytes) -> int:
    """The mask of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # bytes split at ASCII white space alone
    chars = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    mask = int(len(words) < SHORT)
    mask |= 2 * (100 * len(set(words)) < DISTINCT_SHARE * len(words))
    mask |= 4 * (100 * capitals > CAPITAL_SHARE * chars)
    return mask | 8 * (len(text.translate(None, SIGNS)) < len(text))


def _compared(rows: DataFrame) -> DataFrame:
    """(_ROWS) for rows (fp, text, doc_id, part): masks of all rows but those that a neighbouring task decides on.

    Rows are dealt by ranges of (fingerprint, doc_id), so that copies of one text spread over many tasks,
    and sorted by fingerprint, full text and doc_id; each row is held against the first one of its text. A
    text of a task's first fingerprint may have begun in the task before: its rows of smallest id are pending. Of
    a task's last fingerprint, each text's smallest id is summed up. Both carry a digest in place of the text.
    """
    bounded_batches(rows.sparkSession)
    target = arrow_schema(rows.sparkSession, _ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, first, text, least, mask, digest = None, True, None, 0, 0, b""
        runs: list[tuple] = []  # (smallest id, text) of the fingerprint at hand
        for batch in batches:
            for fp, own, doc_id, part in zip(*(c.to_pylist() for c in batch.columns)):
                if fp != now:
                    first, now, text, runs = now is None, fp, None, []
                if own != text:
                    text, least, mask = own, doc_id, own_failures(own)
                    digest = hashlib.sha256(own).digest() if first else b""
                    runs.append((doc_id, own))
                if doc_id > least:
                    out.append((_DECIDED, doc_id, part, mask | REPEATED, None, None))
                elif first:
                    out.append((_PENDING, doc_id, part, mask, fp, digest))
                else:
                    out.append((_DECIDED, doc_id, part, mask, None, None))
                if len(out) >= 8192:
                    yield as_batch(out, target)
                    out = []
        out.extend((_SUMMARY, doc_id, None, 0, now, hashlib.sha256(own).digest()) for doc_id, own in runs)
        if out:
            yield as_batch(out, target)

    dealt = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    return dealt.select("fp", "text", "doc_id", "part").mapInArrow(run, _ROWS)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) for every row: bit k of mask is set if the text fails the k-th of ``FILTERS``.

    A: under 200 words. B: less than half of the words distinct. C: capitals A-Z over 2 % of the characters.
    D: one of #$%&*|. E: a smaller id has the same text anywhere in the table. A null text is empty, a null part is ''.
    Rows that share an id are not copies of each other; rows without an id fail no E and make none fail. Other
    columns are ignored; an empty table gives an empty result.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"), part.alias("part"))
    named = rows.where("doc_id IS NOT NULL").select(F.xxhash64("text").alias("fp"), "text", "doc_id", "part")
    compared = store(_compared(named), "masks")
    # at most as many texts as tasks have last fingerprints
    begun = compared.where(F.col("kind") == _SUMMARY).groupBy("fp", "digest").agg(F.min("doc_id").alias("least"))
    pending = compared.where(F.col("kind") == _PENDING).join(F.broadcast(begun), ["fp", "digest"], "left")
    repeated = F.when(F.col("least") < F.col("doc_id"), F.lit(REPEATED)).otherwise(F.lit(0))
    decided = compared.where(F.col("kind") == _DECIDED).select("doc_id", "part", "mask")
    late = pending.select("doc_id", "part", F.col("mask").bitwiseOR(repeated).alias("mask"))
    columns = {"doc_id": F.col("doc_id"), "part": F.col("part"), "text": F.col("text")}
    nameless = map_texts(rows.where("doc_id IS NULL"), columns, lambda _, i, p, text: (i, p, own_failures(text)), "doc_id long, part string, mask int")
    out = decided.unionByName(late).unionByName(nameless)
    out._gneiss_path = compared._gneiss_path  # type: ignore[attr-defined]
    return out


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by mask, and those with quality or toxic 1.

    At most 32 rows a part, sums of what any slice of the table gives. Of a document with several label rows any
    1 counts; documents without labels are neither.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masks.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    nameless = masks.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    return joined.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def order_rows(part: str, counters: list[dict]) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, step by step, from its counters by mask."""
    n, good, toxic = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
    for c in counters:
        n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
    masks = np.arange(len(n))
    failed = np.array([int(m).bit_count() for m in masks])
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    unique = {f: int(n[b]) for f, b in bits.items()}
    # of all orders, a document goes at each of its failing filters equally often
    shapley = {f: int((n[hit] * (len(ORDERS) // failed[hit])).sum()) for f, b in bits.items() if (hit := masks & b > 0) is not None}
    for order in ORDERS:
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = masks & bits[f] > 0, masks & before > 0
            here = fails & ~gone
            before |= bits[f]
            yield (
                part, order, step, int(n[masks & before == 0].sum()), int(n[here].sum()), int(n[fails & gone].sum()), unique[f],
                int(good[here].sum()), int(toxic[here].sum()), shapley[f],
            )


def filter_interactions(counters: DataFrame) -> DataFrame:
    """What each filter does in each order and step, for every part of ``part_counters``.

    kept: left after the step; removed: gone at it; redundant: failing its filter but gone before; unique_fails:
    failing its filter alone; good_lost and toxic_lost: of those removed; shapley: removed by its filter, over all orders.
    """
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))
    return map_rows(parts, {"part": F.col("part"), "counters": F.col("counters")}, lambda _, part, own: order_rows(part, own), schema)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``filter_interactions`` of all documents; see ``failure_masks`` and ``part_counters`` for odd rows."""
    masks = failure_masks(docs, id_col, text_col, part_col)
    counters = store(part_counters(masks, labels), "counters")
    discard(masks)
    return filter_interactions(counters)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Every order of five filters, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit_filters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


def op13_sql() -> str:
    """The contract of op13 in DuckDB's SQL."""
    steps = [(o, s, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[: s - 1])) for o in ORDERS for s, f in enumerate(o, 1)]
    values = ", ".join(f"('{o}', {s}, {bit}, {before})" for o, s, bit, before in steps)
    return rf"""
WITH steps(filter_order, step, bit, before) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1)::INT AS good, bool_or(toxic = 1)::INT AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (WHERE mask & bit > 0), 0)::BIGINT AS shapley
FROM c CROSS JOIN steps GROUP BY part, filter_order, step, bit, before
"""
