"""Near duplicates on word shingles: SimHash balls find candidates, shingle sets confirm them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil, comb, log, log2

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import as_bytes, components, discard, map_texts, store, unused

#: Words in a shingle, and the share of all shingles of two texts that both have, from which they are alike.
WORDS, SIMILARITY = 5, 0.8
#: Share of bits that differ between two texts of that similarity (0.15 is expected), and the chance that such a pair has no
#: piece within two bits.
DIFFERING, MISSED = 0.15, 0.056
#: Sets of at most so many shingles are also joined on the shingles themselves, which loses no pair.
EXACT = 40
#: Ids that hold more than this share of all pairs are spread over so many tasks.
HOT_SHARE, SALTS = 4096, 64
#: Longs of parities of a set's shingles: two sets differ in no fewer shingles than their parities do.
PARITIES = [f"p{k}" for k in range(16)]


@dataclass(frozen=True)
class Layout:
    """A fingerprint of ``pieces`` of ``bits`` bits, two to a long or one."""

    bits: int
    pieces: int

    @classmethod
    def for_texts(cls, n: int) -> Layout:
        """Pieces so wide that a variant of one has half a text by chance, and so many that few alike pairs lack a close one.

        28 bits and 14 pieces up to four million texts; 34 bits and 30 pieces at 250 million.
        """
        bits = max(28, ceil(log2(max(1, n) * 58)))
        close = sum(comb(bits, i) * DIFFERING**i * (1 - DIFFERING) ** (bits - i) for i in range(3))
        return cls(bits, ceil(log(MISSED) / log(1 - close) / 2) * 2)

    @property
    def to_a_long(self) -> int:
        return 2 if self.bits <= 31 else 1

    @cached_property
    def longs(self) -> list[str]:
        return [f"f{k}" for k in range(-(-self.pieces // self.to_a_long))]

    @property
    def most_bits(self) -> int:
        """Of two alike texts at most so many of all bits differ: a quarter is 4.8 standard deviations over what is expected."""
        return self.pieces * self.bits // 4


_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15
_LOW_BITS = np.uint64(0x0101010101010101)
_SEEN: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    found = _SEEN.get(word)
    if found is None:
        if len(_SEEN) > 100_000:
            _SEEN.clear()
        found = _SEEN[word] = xxhash.xxh64_intdigest(word)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, ascending; no words give none, few words one shingle."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words))
    n = max(1, len(own) - width + 1)
    out = np.full(n, min(len(own), width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(own))):
            out = _mixed(out + own[i : i + n])
    return np.unique(out)


def fingerprint(shingles: np.ndarray, layout: Layout) -> list[int]:
    """SimHash of a set of shingles as the longs of a layout; an empty set has zeros.

    A bit is 1 if more than half of the shingles have it. Bits are counted eight at a time, in the bytes of
    64-bit words, over blocks of at most 255 shingles.
    """
    longs = len(layout.longs)
    counts = np.zeros((longs, 64), dtype=np.int64)
    for at in range(0, len(shingles), 255 * 64):
        part = shingles[at : at + 255 * 64]
        with np.errstate(over="ignore"):
            words = np.stack([_mixed(part + np.uint64((k + 1) * _STEP & (1 << 64) - 1)) for k in range(longs)], axis=1)
        rows = -(-len(part) // 255) * 255
        padded = np.zeros((rows, longs), dtype=np.uint64)
        padded[: len(part)] = words
        for bit in range(8):
            sums = ((padded >> np.uint64(bit)) & _LOW_BITS).reshape(-1, 255, longs).sum(axis=1, dtype=np.uint64)
            counts[:, bit::8] += sums.view(np.uint8).reshape(-1, longs, 8).sum(axis=0, dtype=np.int64)
    used = layout.to_a_long * layout.bits
    bits = counts[:, :used] * 2 > len(shingles)
    return (bits @ (1 << np.arange(used, dtype=np.int64))).tolist()


def parities(shingles: np.ndarray) -> list[int]:
    """Of each of 1,024 classes of shingles whether the set has an odd number, as longs."""
    odd = np.bincount((shingles & np.uint64(64 * len(PARITIES) - 1)).view(np.int64), minlength=64 * len(PARITIES)).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def texts_as_nodes(docs: DataFrame, id_col: str, text_col: str, layout: Layout) -> DataFrame:
    """(doc_id, d1, d2, n, short, f0, ..., p0, ...): digest of each text's words, size of its shingle set, the set if it is small, fingerprint, parities."""

    def row(_: object, doc_id: int, text: bytes) -> tuple:
        digest = xxhash.xxh3_128_intdigest(b" ".join(text.lower().split()))
        shingles = shingle_set(text)
        short = shingles.view(np.int64).tolist() if len(shingles) <= EXACT / SIMILARITY else None
        return doc_id, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), len(shingles), short, *fingerprint(shingles, layout), *parities(shingles)

    columns = {"doc_id": F.col(id_col).cast("long"), "text": as_bytes(text_col)}
    schema = "doc_id long, d1 long, d2 long, n long, short array<bigint>, " + ", ".join(f"{f} long" for f in [*layout.longs, *PARITIES])
    return map_texts(docs, columns, row, schema)


def variants(nodes: DataFrame, layout: Layout) -> DataFrame:
    """(key, rep): each piece itself and its variants within one bit, half of the two bits that may differ."""
    bits, mask = layout.bits, (1 << layout.bits) - 1
    shifts = [s * bits for s in range(layout.to_a_long)]
    words = [F.shiftright(f, s).bitwiseAND(F.lit(mask)) for f in layout.longs for s in shifts][: layout.pieces]
    return (
        nodes.select("rep", F.posexplode(F.array(*words)).alias("piece", "w"))
        .select("rep", "piece", "w", F.explode(F.expr(f"sequence(0, {bits})")).alias("j"))
        .select(F.expr(f"shiftleft(CAST(piece AS BIGINT), {bits}) | (w ^ (CASE WHEN j = {bits} THEN 0L ELSE shiftleft(1L, j) END))").alias("key"), "rep")
    )


def rare_shingles(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, rep): of each small set the shingles on which any alike set of any size must meet it, as keys below zero.

    Two sets that share ``similarity`` of theirs share one of the first n - similarity n + 1 of either in any fixed order: here the
    rarest among small sets come first, so what many texts have in common brings none of them together. Shingles that no
    other small set has take their places but need no key. A set that is alike to one of ``EXACT`` shingles is no larger than
    those that are looked at.
    """
    each = nodes.where("short IS NOT NULL").select("rep", "n", F.explode("short").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    order = Window.partitionBy("rep").orderBy(F.coalesce("c", F.lit(1)), "h")
    placed = each.join(shared, "h", "left").withColumn("place", F.row_number().over(order))
    first = placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & F.col("c").isNotNull())
    return first.select((-F.shiftrightunsigned("h", 1) - 1).alias("key"), "rep")


def ball_rows(keys: DataFrame) -> DataFrame:
    """(key, rep, center, many) of the rows (key, rep) whose key several nodes have.

    Of a key's nodes ``center`` is the smallest; ``many`` says that there are more than two.
    """
    order = Window.partitionBy("key").orderBy("rep")
    near = {f"{side}{n}": getattr(F, side)("rep", n).over(order) for side in ("lag", "lead") for n in (1, 2)}
    met = keys.select("key", "rep", F.first("rep").over(order).alias("center"), *(c.alias(n) for n, c in near.items()))
    many = F.coalesce("lag2", "lead2").isNotNull() | (F.col("lag1").isNotNull() & F.col("lead1").isNotNull())
    return met.where("lag1 IS NOT NULL OR lead1 IS NOT NULL").select("key", "rep", "center", many.alias("many"))


def hot_ids(pairs: DataFrame, key: str) -> DataFrame:
    """Ids that hold more than a ``HOT_SHARE``-th of all pairs, of which there can be no more than that many."""
    least = max(1000, pairs.count() // HOT_SHARE)
    return pairs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(F.col(key).alias("_hot"))


def spread_lookup(pairs: DataFrame, table: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """``pairs`` joined with the rows of ``table`` for their ``key``.

    The ``hot`` keys are dealt to ``SALTS`` tasks by the other id; only their rows of ``table`` are copied.
    """
    dealt = pairs.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    rows = table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    copies = F.when(F.col("_hot").isNotNull(), F.expr(f"sequence(0, {SALTS - 1})")).otherwise(F.array(F.lit(0)))
    return dealt.join(rows.withColumn("_salt", F.explode(copies)).drop("_hot"), [key, "_salt"]).drop("_salt")


def looked_up(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Stored ``pairs`` with the columns of ``table`` for either id, named a_ and b_."""
    out = pairs
    for key, other in (("a", "b"), ("b", "a")):
        side = table.select(F.col("rep").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in table.columns if c != "rep"))
        out = spread_lookup(out, side, key, other, hot_ids(pairs, key))
    return out


def may_be_alike(a: str, b: str, layout: Layout, similarity: float) -> Column:
    """Whether sizes, fingerprints (but for small sets, whose bits say less) and parities, in columns with these prefixes, allow it.

    Sets of sizes n and m that are alike differ in no more than (1 - t) / (1 + t) (n + m) shingles.
    """
    col = lambda p, c: F.col(f"{p}_{c}")
    apart = lambda longs: sum((F.bit_count(col(a, f).bitwiseXOR(col(b, f))) for f in longs), F.lit(0))
    low, high = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    most = F.lit((1 - similarity) / (1 + similarity)) * (low + high) + F.lit(1e-6)
    return (low >= F.lit(similarity) * high) & (apart(PARITIES) <= most) & ((low <= EXACT) | (apart(layout.longs) <= layout.most_bits))


def confirmed(pairs: DataFrame, nodes: DataFrame, layout: Layout, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have ``similarity`` or more in common.

    ``may_be_alike`` rules most chance pairs out; only the texts of the others are cut into shingles again, and each
    pair's sets are compared.
    """
    both = looked_up(pairs, nodes.select("rep", "n", *layout.longs, *PARITIES))
    close = store(both.where(may_be_alike("a", "b", layout, similarity)).select("a", "b"), "close")
    ids = close.select(F.col("a").alias("_id")).union(close.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), as_bytes(text_col).alias("text"))
    asked = texts.join(ids, F.col("rep") == F.col("_id"), "left_semi")
    sets = map_texts(
        asked, {"rep": F.col("rep"), "text": F.col("text")}, lambda _, rep, text: (rep, shingle_set(text).view(np.int64).tolist()), "rep long, s array<bigint>"
    )
    sets = store(sets.dropDuplicates(), "shingles")
    met = looked_up(close, sets)
    shared = F.size(F.array_intersect("a_s", "b_s"))
    whole = met.select("a", "b", shared.alias("c"), (F.size("a_s") + F.size("b_s")).alias("n"))
    out = store(whole.where(F.col("c") >= F.lit(similarity) * (F.col("n") - F.col("c")) - F.lit(1e-9)).select("a", "b").distinct(), "alike")
    discard(close)
    discard(sets)
    return out


def near_links(nodes: DataFrame, layout: Layout, docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join the candidates which are alike, into the groups that all such pairs would give.

    First each node meets the first node of each of its keys (variants of pieces, and shingles of small sets): a pair for a row of
    a key, however many nodes it has, and mostly the same pair for all keys of a large group. A key each of whose rows is alike
    to its first is one group and settled. Of the others, those whose nodes are not all in one group by now give the pairs between
    their largest group and the others, and among these; pairs within a group add nothing, and those that ``may_be_alike`` rules out
    are not made.
    """
    exact = rare_shingles(nodes, similarity)
    balls = store(ball_rows(variants(nodes, layout).unionByName(exact)), "balls")
    pairs = balls.select(F.col("center").alias("a"), F.col("rep").alias("b")).where("a < b").distinct()
    pairs = store(pairs, "pairs")
    first = confirmed(pairs, nodes, layout, docs, id_col, text_col, similarity)
    roots = store(components(first), "roots")
    shared = balls.where("many")
    loose = shared.where("center < rep").join(first.select(F.col("a").alias("center"), F.col("b").alias("rep")), ["center", "rep"], "left_anti")
    open_ = shared.select("key", "rep").join(loose.select("key").distinct(), "key", "left_semi").join(roots, F.col("rep") == F.col("node"), "left")
    open_ = store(open_.select("key", "rep", F.coalesce("root", "rep").alias("root")), "open")
    parts = open_.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
    split = open_.join(parts.where("parts > 1").select("key", "main"), "key").join(nodes.select("rep", "n", *layout.longs, *PARITIES), "rep")
    side = lambda df, p: df.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("rep", "root", "n", *layout.longs, *PARITIES)))
    across = (F.col("x_root") != F.col("y_root")) & may_be_alike("x", "y", layout, similarity)
    more = side(split.where("root <> main"), "x").join(side(split, "y"), "key").where(across)
    more = more.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = store(more, "pairs")
    second = confirmed(more, nodes, layout, docs, id_col, text_col, similarity)
    known = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    out = store(known.unionByName(second), "links")
    for table in (balls, pairs, first, roots, open_, more, second):
        discard(table)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(rep, d1, d2, component_id) for each distinct text: rep is the smallest id that has it, component_id the
    smallest id reachable over texts that are alike.

    Texts are alike if they share ``similarity`` of their sets of five-word shingles (the shared shingles over
    all of either); texts without words are alike, and a text of fewer words is one shingle. Sets of up to ``EXACT``
    shingles meet every alike set. Of larger ones, candidates come from SimHash pieces that differ in at most two bits: a pair at
    exactly 0.8 has one with a chance of about 0.94, at 0.85 of 0.99; what becomes a candidate is compared exactly. Rows that
    share an id count as one document; texts that only rows without an id have are left out.
    """
    layout = Layout.for_texts(docs.count())
    nodes = texts_as_nodes(docs, id_col, text_col, layout).groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("short").alias("short"), *(F.first(f).alias(f) for f in [*layout.longs, *PARITIES])
    )  # equal words have equal fingerprints, so any row's will do
    nodes = store(nodes.where("rep IS NOT NULL"), "nodes")
    links = near_links(nodes, layout, docs, id_col, text_col, similarity)
    roots = components(links).withColumnRenamed("node", "rep")
    out = store(nodes.join(roots, "rep", "left").select("rep", "d1", "d2", F.coalesce("root", "rep").alias("component_id")), "groups")
    discard(nodes)
    discard(links)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; rows whose id is null stay.

    Rows that share an id stay or go together; other columns are carried along; an empty table gives an
    empty result.
    """
    (mark,) = unused(docs, "_kept")
    groups = near_groups(docs, id_col, text_col, similarity)
    kept = groups.where("rep = component_id").select(F.col("rep").alias(mark)).distinct()
    joined = docs.join(kept, F.col(id_col).cast("long") == F.col(mark), "left")
    return joined.where(F.col(id_col).isNull() | F.col(mark).isNotNull()).drop(mark)
