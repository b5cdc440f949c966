"""Document fingerprints from closed syncmers, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A k-mer is K tokens; it is chosen if the smallest of its S-token substrings is its first or last one.
K, S = 6, 2
#: Documents (by id) whose successors one task finds, and the parts of equally many documents that ids are first cut into.
BUCKET_DOCS, PARTS = 4096, 256
#: Beyond so many buckets, first documents are found by a shuffled join.
BROADCAST_BUCKETS = 500_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Words; the characters of a word of more than 16, so that text without spaces has tokens that depend on nothing before them."""
    word = r"[^\x20\x09-\x0D]"
    return F.regexp_extract_all(text, F.lit(rf"(?<!{word}){word}{{1,16}}(?!{word})|{word}"), F.lit(0))


def _chosen(words: Column, k: int, s: int, emit: Callable[[Column, Column], Column]) -> Column:
    """``emit(hash, position)`` for each closed syncmer of a token array, nulls elsewhere.

    Whether a k-mer is chosen depends on its own tokens only, so an edit changes no anchor outside of the
    k-mers that it touches. A text of fewer than ``k`` tokens has one anchor, all of it.
    """

    def over(inner: Column) -> Column:
        last = F.size(inner) - k

        def one(h: Column, i: Column) -> Column:
            window = [h, *(F.get(inner, i + j) for j in range(1, k - s + 1))]
            closed = F.least(*window) == F.least(window[0], window[-1])
            ends = [*range(0, k - s, s), k - s]
            return F.when((i <= last) & closed, emit(F.xxhash64(*(window[j] for j in ends)), i))

        return F.transform(inner, one)

    inner = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, s))))
    short = F.transform(F.slice(words, 1, 1), lambda w: emit(F.xxhash64(F.array_join(words, " ")), F.lit(0)))
    return F.when(F.size(words) < k, short).otherwise(_let(inner, over))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All closed syncmers of a text as (hash, position in tokens), in text order; hashes have 32 bits."""
    short = lambda h, i: F.struct(h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"), i.alias("pos"))
    return _let(tokens(text), lambda w: F.array_compact(_chosen(w, k, s, short)))


def first_anchors(found: Column) -> Column:
    """Each anchor of a text once, where it comes first, ordered by hash."""
    return _let(F.sort_array(found), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["hash"] != x["hash"])))


def fingerprint(found: Column) -> Column:
    """The anchors of ``first_anchors`` in text order, each as 8 hex digits of its hash and its position."""
    placed = F.sort_array(F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"))))
    return F.array_join(F.transform(placed, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 8, "0"), F.lit("@"), x["pos"].cast("string"))), " ")


def matching_positions(a: Column, b: Column) -> Column:
    """(pos_a, pos_b) of the anchors that two texts share, from their ``first_anchors``: one merge of both."""
    side = lambda found, n: F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(n).alias("side"), x["pos"].alias("pos")))
    pair = lambda m: F.transform(
        m, lambda x, i: F.when((x["side"] == 0) & (F.get(m, i + 1)["hash"] == x["hash"]), F.struct(x["pos"].alias("pos_a"), F.get(m, i + 1)["pos"].alias("pos_b")))
    )
    return _let(F.sort_array(F.concat(side(a, 0), side(b, 1))), lambda m: F.array_compact(pair(m)))


def covered(positions: Column, k: int = K) -> Column:
    """How many tokens lie in the k-mers at these positions."""
    own = lambda p: F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k))))
    return _let(F.sort_array(positions), lambda p: F.aggregate(own(p), F.lit(0), lambda n, x: n + x))


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Share of both texts that lies in anchors which they share, 0 to 1 (1 if neither has any).

    Texts are given by their ``first_anchors``, all of them. Anchors follow each other at less than ``k``
    tokens, so a shared passage is covered up to its ends, and half of a text kept gives a half.
    """
    pos = lambda found, name: F.transform(found, lambda x: x[name])
    whole = covered(pos(a, "pos"), k) + covered(pos(b, "pos"), k)
    shared = _let(matching_positions(a, b), lambda m: covered(pos(m, "pos_a"), k) + covered(pos(m, "pos_b"), k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / whole)


def with_next(rows: DataFrame, id_col: str, carried: list[str], bucket_docs: int = BUCKET_DOCS, broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """``rows`` with a struct ``next`` of the ``carried`` columns of the row with the next larger id.

    After the largest id comes the smallest. Rows that share an id follow each other by a hash of their
    values; a null id comes first. Rows meet in buckets of neighbouring ids (one shuffle): ids are cut into
    ``PARTS`` parts of about as many rows, and each part evenly, so ids far off from all others fill no
    bucket. The first row of each bucket is sent to the bucket before as well, so no task sees more than its
    own bucket.
    """
    keyed = rows.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    shares = F.percentile_approx("_key", F.lit([i / PARTS for i in range(PARTS + 1)]), F.lit(10 * PARTS))
    cuts, n = keyed.agg(shares, F.count("*")).first()
    cuts = sorted(set(cuts or [0]))
    each = max(1.0, n / PARTS / bucket_docs)
    # doubles keep the order of longs, and their differences don't overflow
    low, width = (F.lit([float(x) for x in xs]) for xs in (cuts, [max(1.0, (float(b) - float(a)) / each) for a, b in zip(cuts, [*cuts[1:], cuts[-1]])]))
    part = F.greatest(F.lit(0), F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_key"))) - 1)
    keyed = keyed.withColumn("_part", part)
    place = F.floor((F.col("_key").cast("double") - F.get(low, F.col("_part"))) / F.get(width, F.col("_part")))
    keyed = keyed.withColumn("_bucket", F.struct("_part", place.alias("_place")))
    # a few numbers for each bucket of ids, then for each part
    firsts = keyed.groupBy("_part", "_bucket").agg(F.min("_key").alias("_first"))
    parts = firsts.groupBy("_part").agg(F.max("_bucket").alias("_end"))
    whole = Window.orderBy("_part")  # PARTS rows at most
    parts = parts.select("_part", F.coalesce(F.lag("_end").over(whole), F.max("_end").over(Window.partitionBy())).alias("_before"))
    within = F.lag("_bucket").over(Window.partitionBy("_part").orderBy("_bucket"))
    firsts = firsts.withColumn("_within", within).join(F.broadcast(parts), "_part").select("_first", F.coalesce("_within", "_before").alias("_to"))
    if n / bucket_docs <= broadcast_buckets:
        firsts = F.broadcast(firsts)  # at most as many rows as buckets: 2 for each that is full, and one for each part
    heads = keyed.join(firsts, keyed["_key"] == firsts["_first"]).drop("_first", "_bucket").withColumnRenamed("_to", "_bucket")
    both = keyed.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True)))
    tie = F.xxhash64(*(c for c in rows.columns))
    follow = Window.partitionBy("_bucket").orderBy("_head", "_key", tie)
    out = both.withColumn("next", F.lead(F.struct(*carried)).over(follow)).where(~F.col("_head"))
    return out.select(*rows.columns, "next")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many of another."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def compare_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    Null texts count as empty; repeated rows stay, each followed by the next; a lone document follows
    itself; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    paired = with_next(rows, "doc_id", ["text"])
    found = lambda text: first_anchors(anchors(text))
    whole = _let(
        edited_text(F.col("text"), F.col("next.text")),
        lambda e: F.struct(F.sha2(e, 256).alias("sha"), found(e).alias("edited"), found(F.col("text")).alias("own"), found(F.col("next.text")).alias("next")),
    )
    values = _let(
        whole,
        lambda w: F.struct(
            w["sha"].alias("edited_sha256"),
            fingerprint(w["own"]).alias("fingerprint"),
            fingerprint(w["edited"]).alias("edited_fingerprint"),
            likeness(w["own"], w["edited"]).alias("near_edited"),
            likeness(w["own"], w["next"]).alias("near_next"),
        ),
    )
    return paired.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.inline(F.array(values)))


def op2_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
