"""Operators over ordered rows: islands, carried values and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StringType, StructType

from gneiss.functions.text import chapter_prefix

#: Chapter names that stand for "as before", and marks of names that are none.
CONTINUED = ("CONTINUACIÓN_ANTERIOR", "CONTINUACION_ANTERIOR", "SIN CAPÍTULO", "SIN CAPITULO", "")
NO_NAME = ("[", "NOT FOUND", "NO ESPECIFICADO", "NO IDENTIFICADO", "NO ENCONTRADO", "UNKNOWN", "UNDEFINED", "SIN NOMBRE")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, alias: str = "island") -> DataFrame:
    """Number the runs of rows that begin where ``starts`` holds, from 0 before the first."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(alias, F.sum(F.when(starts, 1).otherwise(0)).over(upto))


def grouped_runs(df: DataFrame, keys: list[str], order: str, easy: str, same: str, size: int = 5) -> DataFrame:
    """Group consecutive easy rows with the same value, at most ``size`` to a group; others stand alone."""
    w = Window.partitionBy(*keys).orderBy(order)
    breaks = ~F.col(easy) | F.coalesce(~F.lag(easy).over(w), F.lit(True)) | F.coalesce(F.lag(same).over(w) != F.col(same), F.lit(True))
    runs = islands(df.withColumn("_b", breaks), keys, [order], F.col("_b"), "_run").drop("_b")
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order)) - 1
    part = runs.withColumn("_part", F.floor(place / size))
    first = F.first(order).over(Window.partitionBy(*keys, "_run", "_part").orderBy(order))
    return part.withColumn("group_id", first).drop("_run", "_part")


def streamed(df: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]]) -> DataFrame:
    """Rows that ``step(state, values)`` gives for each row of a key, in order, after the key's columns.

    For state that depends on all rows before and has no shorter form. Rows are shuffled by key, sorted and
    streamed, so a task holds one state and one batch, however many rows a key has; a key's rows take one
    task. ``start()`` makes the state of a key, which ``step`` changes in place.
    """
    return _streamed(df.repartition(*keys), keys, order, values, schema, start, step, None)


def chunk_summaries(df: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], end: Callable[[object], tuple]) -> DataFrame:
    """(keys, chunk, ``end(state)``) for each run of a key's rows in one range of (key, order).

    For state changes that compose: rows are dealt by ranges, so a key with very many rows spreads over many
    tasks. Chunks are numbered in order; a key has no more of them than there are partitions.
    """
    return _streamed(df.repartitionByRange(*keys, *order), keys, order, values, f"chunk int, {schema}", start, step, end)


def _streamed(dealt: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, start, step, end) -> DataFrame:
    kinds = dict(dealt.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    target = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        out: list[tuple] = []
        now, state = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != row[:n]:
                    if now is not None and end:
                        out.append((*now, chunk, *end(state)))
                    now, state = row[:n], start()
                out.extend((*now, *x) for x in step(state, row[n:]))
                if len(out) >= 8192:
                    yield _batch(out, target)
                    out = []
        if now is not None and end:
            out.append((*now, chunk, *end(state)))
        if out:
            yield _batch(out, target)

    return dealt.sortWithinPartitions(*keys, *order).select(*keys, *values).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def canonical_chapters(df: DataFrame, keys: list[str], order: str, chapter: str = "chapter") -> DataFrame:
    """One name for each chapter prefix: the first that has more than its code, else the first."""
    name = F.trim(F.coalesce(chapter, F.lit("")))
    rows = df.withColumn("_name", name).withColumn("_prefix", chapter_prefix(name))
    named = F.when(F.length("_name") > F.length("_prefix") + 2, F.col("_name"))
    all_ = Window.partitionBy(*keys, "_prefix").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.coalesce(F.first(named, ignorenulls=True).over(all_), F.first("_name").over(all_))
    return rows.withColumn(chapter, F.when(F.col("_prefix") == "", F.col(chapter)).otherwise(best)).drop("_name", "_prefix")


def stable_chapter(new: str, prefix: str, nameless: bool, state: list) -> str:
    """The chapter after a row that names ``new``; ``state`` is [chapter, its prefix, whether it stands for none]."""
    if nameless:
        return state[0]
    if not state[2] and prefix == state[1] and len(new) <= len(state[0]) + 3:
        return state[0]
    state[:] = new, prefix, new.upper() in CONTINUED
    return new


def forward_fill_chapter(df: DataFrame, keys: list[str], order: str, chapter: str = "chapter") -> DataFrame:
    """(keys, order, chapter): the last chapter carried on; of names with the same prefix the longer, by over three characters, wins."""
    return with_chapter_filled(df.select(*keys, order, chapter), keys, order, chapter)


def with_chapter_filled(df: DataFrame, keys: list[str], order: str, chapter: str = "chapter", dealt: bool = False) -> DataFrame:
    """``df`` with ``forward_fill_chapter`` as its last column, dealt as in ``folded``."""
    new = F.trim(F.coalesce(chapter, F.lit("")))
    up = F.upper(new)
    nameless = up.isin(*CONTINUED) | F.exists(F.array(*map(F.lit, NO_NAME)), lambda p: F.contains(up, p))
    rows = df.withColumns({"_new": new, "_prefix": chapter_prefix(new), "_none": nameless}).drop(chapter)
    return folded(rows, keys, order, ["_new", "_prefix", "_none"], chapter, lambda: ["", "", True], lambda state, row: stable_chapter(*row, state), dealt, StringType())


def drop_carry_over(df: DataFrame, keys: list[str], block: str, order: str, quantity: str, nothing_left: float | None = 0.0) -> DataFrame:
    """Sum of each block's quantities, without a first row that repeats the block before's total.

    The total carried on is the last positive one after such a row was left out. A block that had no other row gets
    ``nothing_left``. Blocks are summed first, with their first quantity apart; then one row a block is streamed.
    """
    blocks = df.groupBy(*keys, block).agg(*block_sums(F.col(quantity).cast("double"), F.col(order)))
    return without_carry_over(blocks.where("_sum IS NOT NULL"), keys, block, quantity, nothing_left)


def block_sums(quantity: Column, order: Column) -> list[Column]:
    """What ``without_carry_over`` needs of each block: its first quantity, their sum and their number; null ones are left out."""
    first = F.min_by(quantity, F.when(quantity.isNotNull(), F.struct(order, quantity)))
    return [first.alias("_first"), F.sum(quantity).alias("_sum"), F.count(quantity).alias("_rows")]


def without_carry_over(blocks: DataFrame, keys: list[str], block: str, quantity: str, nothing_left: float | None = 0.0, dealt: bool = False) -> DataFrame:
    """``blocks`` (a row each, with ``block_sums``) with the quantity of each, as ``drop_carry_over`` has it, instead of the sums.

    A block without quantities has none and changes nothing for the next. Other columns pass as they are, so nothing needs
    to be joined to the result.
    """

    def step(state: list, row: tuple) -> float | None:
        first, whole, n = row
        if whole is None:
            return None
        carried = state[0] > 0 and abs(first - state[0]) < 0.01
        own = whole - first if carried else whole
        if carried and n == 1:
            return nothing_left
        if own > 0:
            state[0] = own
        return own

    return folded(blocks, keys, block, ["_first", "_sum", "_rows"], quantity, lambda: [0.0], step, dealt)


def folded(
    df: DataFrame, keys: list[str], order: str, values: list[str], alias: str, start: Callable[[], object], step: Callable[[object, tuple], object], dealt: bool = False, kind: DataType = DoubleType()
) -> DataFrame:
    """``df`` with a value (of ``kind``) that ``step(state, values)`` gives for each row of a key, in order, instead of ``values``.

    Dealt and streamed as in ``streamed``; only keys and values become Python's. ``dealt`` says that a window over ``keys``
    was the last to deal the rows, so that they needn't be shuffled again.
    """
    rest = [c for c in df.columns if c not in values]
    dealt = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, order).select(*rest, *values)
    n, at, made = len(rest), [rest.index(k) for k in keys], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch.column(i).to_pylist() for i in at)), zip(*(c.to_pylist() for c in batch.columns[n:]))):
                if now != key:
                    now, state = key, start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, type=made)], names=[*rest, alias])

    return dealt.mapInArrow(run, StructType(dealt.schema.fields[:n]).add(alias, kind))


def merge_tails(items: DataFrame, pages: DataFrame, keys: list[str], page: str, order: str, text: str) -> DataFrame:
    """``items`` whose last one on a truncated page takes over the orphan text that opens the next page.

    ``pages`` has a row for each page that was read: keys, page, ``truncated`` and ``tail`` (either may be null). The next
    page is the next such row, whatever its number; a page without items takes over nothing, a blank tail adds nothing.
    """
    last = Window.partitionBy(*keys, page).orderBy(F.desc(order))
    tail = F.nullif(F.trim(F.lead("tail").over(Window.partitionBy(*keys).orderBy(page))), F.lit(""))
    cut = pages.select(*keys, page, "truncated", tail.alias("_tail")).where("truncated AND _tail IS NOT NULL").drop("truncated")
    rows = items.withColumn("_n", F.row_number().over(last)).join(cut, [*keys, page], "left")
    merged = F.concat(F.rtrim(F.coalesce(text, F.lit(""))), F.lit(" "), "_tail")
    return rows.withColumn(text, F.when((F.col("_n") == 1) & F.col("_tail").isNotNull(), merged).otherwise(F.col(text))).drop("_n", "_tail")


def clamped_score(df: DataFrame, keys: list[str], order: str, event_id: str, delta: str, start: float = 0.0) -> DataFrame:
    """Final score of each key: an event counts once, and the score stays within 0 and 100 after each.

    To add and then clamp, over and over, is to add once and clamp once: each range of a key's events becomes
    three numbers, and these are applied in order.
    """
    first = Window.partitionBy(*keys, event_id).orderBy(order)
    once = df.withColumn("_n", F.row_number().over(first)).where("_n = 1")

    def step(state: list, row: tuple) -> tuple:
        d = row[0] or 0.0
        state[:] = state[0] + d, min(100.0, max(0.0, state[1] + d)), min(100.0, max(0.0, state[2] + d))
        return ()

    infinite = float("inf")
    parts = chunk_summaries(once, keys, [order, event_id], [delta], "added double, low double, high double", lambda: [0.0, -infinite, infinite], step, tuple)
    rows = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk", "added", "low", "high"))).alias("_parts"))
    apply = lambda s, x: F.greatest(x["low"], F.least(x["high"], s + x["added"]))
    return rows.select(*keys, F.aggregate("_parts", F.lit(float(start)), apply).alias("score"))
