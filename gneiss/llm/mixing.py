"""Mixing sources to target weights: fixed blocks of words, multinomial draws by shard, keyed permutations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import arrow_schema, as_bytes, discard, map_rows, store

#: Words of a block, slots of an output shard, documents of a bucket within which offsets are summed.
BLOCK, SHARD, BUCKET = 64, 16_384, 1024
#: Slots that one task deals out.
TASK_SLOTS = 1 << 20
#: Weights of the sources in order, repeating; and how often a source is used at most.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
SEED = 42
#: Sources whose probabilities a task may hold: 32 MB.
MOST_SOURCES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
_SLOTS = "shard long, slot long, rank int, epoch int, block long"
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each of ``index``, from 0 to before ``n``, goes in the permutation of ``key``.

    Four Feistel rounds over the next power of four; what falls beyond ``n`` goes round again.
    """
    half = _U(max(1, ((n - 1).bit_length() + 1) // 2))
    low = _U((1 << int(half)) - 1)
    keys = [_U(xxhash.xxh64_intdigest(f"{key}/{r}")) for r in range(4)]
    out, todo = index.astype(_U), np.arange(len(index))
    while len(todo):
        x = out[todo]
        a, b = x >> half, x & low
        with np.errstate(over="ignore"):
            for k in keys:
                a, b = b, a ^ (_mixed(b + k) & low)
        out[todo] = (a << half) | b
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target, capped) for rows (source, size).

    Sources by code point, null last, have the weights in turn and share the sum of all sizes by them; a
    target stops at ``most_epochs`` times its source's size, and what is over is shared by weight among the
    others until none is above. In the order of size over weight the sources that stop come first, so sums along that
    order tell which they are. One row a source goes through one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.array(*(F.lit(w) for w in weights))
    exact = "decimal(38,0)"
    named = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    named = named.withColumn("w", F.element_at(turn, F.pmod("rank", F.lit(len(weights))) + 1).cast(exact))
    most = (F.col("source_size") * most_epochs).cast(exact)
    common = int(np.lcm.reduce(np.array(weights, dtype=np.int64)))
    order = Window.orderBy(F.col("source_size") * F.expr(f"CAST({common} DIV w AS BIGINT)"), "rank")
    everything = Window.partitionBy()
    ordered = named.select(
        "*",
        most.alias("most"),
        F.sum(F.col("source_size").cast(exact)).over(everything).cast(exact).alias("total"),
        F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(exact).alias("stopped"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(exact).alias("rest"),
    )
    marked = ordered.withColumn("capped", F.expr("most * rest <= w * (total - stopped)"))
    level = marked.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0)).cast(exact).alias("gone"),
        F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything).cast(exact).alias("left"),
    )
    shared = F.expr("CAST((total - gone) * w AS DOUBLE) / CAST(left AS DOUBLE)")
    return level.select("source", "rank", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(shared).alias("target"), "capped")


@dataclass
class Quotas:
    """What a task knows of the sources, by rank: arrays of one number a source."""

    keys: list[str]
    blocks: np.ndarray
    slots: np.ndarray
    seed: int

    @classmethod
    def of(cls, targets: DataFrame, block: int, most_epochs: int, seed: int) -> Quotas:
        """Slots for each source: whole rounds of its blocks, and as many blocks as come nearest to the rest."""
        rows = targets.orderBy("rank").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"over {MOST_SOURCES} sources: their probabilities are too many to hold in a task")
        blocks = np.array([-(-r.source_size // block) for r in rows], dtype=np.int64)
        slots = []
        for r, n in zip(rows, blocks.tolist()):
            rounds = most_epochs if r.capped else int(r.target // r.source_size) if r.source_size else 0
            over = max(0.0, r.target - rounds * r.source_size)
            slots.append(min(most_epochs * n, rounds * n + round(over / block)))
        return cls([f"{'' if r.source is None else '='}{r.source}" for r in rows], blocks, np.array(slots, dtype=np.int64), seed)

    def random(self, *key: object) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(xxhash.xxh64_intdigest("/".join(map(str, (self.seed, *key))))))

    def draw(self, shard: int, size: int) -> np.ndarray:
        """How many of a shard's ``size`` slots each source fills."""
        return self.random("shard", shard).multinomial(size, self.slots / max(1, self.slots.sum()))

    def places(self, rank: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(epoch, block) of the k-th slots of a source: in each epoch another permutation of its blocks."""
        n = int(self.blocks[rank])
        epoch, index = np.divmod(k, n)
        block = np.empty_like(index)
        for e in np.unique(epoch).tolist():
            at = epoch == e
            block[at] = permuted(index[at], n, xxhash.xxh64_intdigest(f"{self.seed}/{self.keys[rank]}/{e}"))
        return epoch, block


def _draws(spark, quotas: Quotas, shard: int) -> DataFrame:
    """(shard, rank, n, at): n slots of a shard, from place ``at`` on, go to a source."""
    total = int(quotas.slots.sum())
    n_shards = -(-total // shard)
    spread = spark.sparkContext.broadcast(quotas)
    target = arrow_schema(spark, "shard long, rank int, n long, at long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                n = spread.value.draw(s, min(shard, total - s * shard))
                ranks = np.flatnonzero(n)
                at = np.cumsum(n[ranks]) - n[ranks]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), s)), pa.array(ranks, pa.int32()), pa.array(n[ranks]), pa.array(at)], schema=target)

    return spark.range(0, n_shards, 1).mapInArrow(run, "shard long, rank int, n long, at long")


def dealt_slots(spark, quotas: Quotas, shard: int = SHARD) -> DataFrame:
    """(shard, slot, rank, epoch, block): the block of which source each slot of each shard gets.

    Every shard draws multinomial counts of its sources by a key of its own. Over all shards a source's draws miss
    its quota by chance: slots of sources that drew too many are then handed, in order, to those that drew too few,
    so totals are exact. The slots of a source are numbered along the shards and sent through its permutations; within a
    shard they are permuted too.
    """
    draws = store(_draws(spark, quotas, shard), "draws")
    drawn = np.zeros(len(quotas.slots), dtype=np.int64)
    for r in draws.groupBy("rank").agg(F.sum("n").alias("n")).collect():  # one row a source, of which Quotas holds as many
        drawn[r["rank"]] = r["n"]
    over, under = np.maximum(drawn - quotas.slots, 0), np.maximum(quotas.slots - drawn, 0)
    over_at, under_end = np.cumsum(over) - over, np.cumsum(under)
    total = int(quotas.slots.sum())
    spread = spark.sparkContext.broadcast((quotas, drawn, over_at, under_end))
    target = arrow_schema(spark, _SLOTS)
    first = F.sum("n").over(Window.partitionBy("rank").orderBy("shard")) - F.col("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, had, start, ends = spread.value
        for batch in batches:
            for s, rank, n, at, k0 in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.arange(k0, k0 + n, dtype=np.int64)
                to = np.full(n, rank, dtype=np.int64)
                extra = k >= own.slots[rank]
                handed = start[rank] + k[extra] - own.slots[rank]
                to[extra] = np.searchsorted(ends, handed, side="right")
                k[extra] = had[to[extra]] + handed - (ends[to[extra]] - np.maximum(own.slots - had, 0)[to[extra]])
                slot = permuted(np.arange(at, at + n, dtype=np.int64), min(shard, total - s * shard), xxhash.xxh64_intdigest(f"{own.seed}/slots/{s}"))
                epoch, block = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
                for r in np.unique(to).tolist():
                    here = to == r
                    epoch[here], block[here] = own.places(r, k[here])
                columns = [pa.array(np.full(n, s)), pa.array(slot), pa.array(to, pa.int32()), pa.array(epoch, pa.int32()), pa.array(block)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    numbered = draws.select("shard", "rank", "n", "at", first.alias("k0"))
    tasks = min(-(-total // shard), spark.sparkContext.defaultParallelism + total // TASK_SLOTS)  # a row of draws makes many slots
    return numbered.repartition(max(1, tasks), "shard").mapInArrow(run, _SLOTS)


@dataclass
class Mix:
    """A mix of ``docs``: what each source gives, where its documents lie in its stream, and the slots."""

    targets: DataFrame
    placed: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """(rank, block, offset, doc_id, size, n): n words of a document lie in a block of its source."""
        b = self.block
        spans = self.placed.where("size > 0").select("rank", "offset", "doc_id", "size", F.explode(F.expr(f"sequence(offset DIV {b}, (offset + size - 1) DIV {b})")).alias("block"))
        n = F.expr(f"least(offset + size, (block + 1) * {b}) - greatest(offset, block * {b})")
        return spans.select("rank", "block", "offset", "doc_id", "size", n.alias("n"))

    def taken(self) -> DataFrame:
        """``placed`` with the words that the mix takes of each document, repeats counted."""
        # as large as the mix, though it comes of a small table of draws: never to be sent to all tasks
        times = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")
        used = self.pieces().join(times, ["rank", "block"], "left")
        words = used.groupBy("rank", "offset", "doc_id", "size").agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        none = self.placed.where("size = 0").select("rank", "offset", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        return words.unionByName(none)


def _word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
    with_text: bool = False,
) -> Mix:
    """The mix of ``docs`` by the weights of their sources, in blocks of ``block`` words.

    The words of a source's documents, in the order of a hash of id and text, are its stream, cut into blocks (the last
    may be shorter); offsets are summed within buckets of about ``BUCKET`` documents and then over buckets, so a large
    source is no large task. A null text has no words, a null source is one of its own, rows with equal or no ids
    are documents each. A source's words come within two blocks of its target. An empty table gives no rows. The
    same rows give the same mix, however they are partitioned.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _word_count(text).alias("size"), F.xxhash64(text).alias("version")]
    sized = store(docs.select(*columns, *([as_bytes(text_col).alias("text")] if with_text else [])), "sized")
    targets = store(source_targets(sized.select("source", "size"), weights, most_epochs), "targets")
    n_buckets = sized.count() // BUCKET + 1
    known = targets.select(F.col("source").alias("_s"), "rank")
    ranked = sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(n_buckets)))
    sums = ranked.groupBy("rank", "bucket").agg(F.sum("size").alias("all"))
    starts = sums.select("rank", "bucket", (F.sum("all").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("all")).alias("start"))
    order = Window.partitionBy("rank", "bucket").orderBy("doc_id", "version", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.withColumn("within", F.sum("size").over(order) - F.col("size")).join(starts, ["rank", "bucket"])
    placed = store(placed.select("doc_id", "rank", "size", (F.col("start") + F.col("within")).alias("offset"), *(["text"] if with_text else [])), "placed")
    discard(sized)
    return Mix(targets, placed, dealt_slots(spark, Quotas.of(targets, block, most_epochs, seed), shard), block)


def mixed_blocks(docs: DataFrame, **options: object) -> DataFrame:
    """(shard, slot, source, epoch, block, text): the mix itself, a row for each slot, words joined by blanks.

    Takes the options of ``plan_mix``.
    """
    mix = plan_mix(docs, with_text=True, **options)
    size = mix.block

    def cut(_: object, rank: int, offset: int, text: bytes) -> Iterator[tuple]:
        words, at = text.split(), 0
        while at < len(words):
            n = min(len(words) - at, size - (offset + at) % size)
            yield rank, (offset + at) // size, offset + at, b" ".join(words[at : at + n])
            at += n

    columns = {"rank": F.col("rank"), "offset": F.col("offset"), "text": F.col("text")}
    pieces = map_rows(mix.placed.where("size > 0"), columns, cut, "rank int, block long, at long, piece binary")
    texts = pieces.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("all"))
    texts = texts.select("rank", "block", F.array_join(F.transform("all", lambda x: x.piece.cast("string")), " ").alias("text"))
    out = mix.slots.join(texts.hint("merge"), ["rank", "block"]).join(mix.targets.select("rank", "source"), "rank")
    return out.select("shard", "slot", "source", "epoch", "block", "text")


def op12_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    mix = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    targets = mix.targets.select("rank", "source_size", "target")
    return mix.taken().join(targets, "rank").select("doc_id", "size", "source_size", "target", "taken")
