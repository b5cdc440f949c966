"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import as_bytes, components, discard, map_texts, store

#: Shingles whose bits are counted at once; bounds memory on very long texts.
BLOCK = 1 << 15
#: Buckets with more rows than this take the linear path over whole words.
HOT_BUCKET = 1024
#: Fingerprints with more than this share of all rows are looked up without a shuffle.
HOT_SHARE = 4096


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles; no words give 0, fewer words than ``width`` one shingle."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        hashes = [digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(width)))] or [digest(b" ".join(part), seed)]
        bits = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; a null text counts as empty and has fingerprint 0."""
    columns = {"doc_id": F.col(id_col).cast("long"), "text": as_bytes(text_col)}
    return map_texts(docs, columns, lambda _, doc_id, text: (doc_id, simhash(text, width)), "doc_id long, fp long")


def distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def links(nodes: DataFrame, radius: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between representatives that give the groups which all links of ``radius`` bits give.

    ``nodes`` has distinct (fp, rep). Two words at distance <= 3 differ by at most one bit (half the
    radius, rounded down) in one of their 32-bit halves. So every fingerprint emits, for each half, the half
    itself and its variants within one bit; rows meet on a variant, pairs are verified on the whole word.
    Only the 0 -> 1 flip is emitted: of two halves that differ in one bit, one has it unset.

    A variant in more than ``hot_bucket`` rows would give too many pairs. The fingerprints found there take
    the exact linear path of ``ball_links`` instead.
    """
    if radius != 3:
        raise ValueError("the half-word balls are laid out for a radius of 3")
    half = "CASE WHEN h = 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    variants = (
        nodes.withColumn("h", F.explode(F.expr("array(0, 1)")))
        .withColumn("w", F.expr(half))
        .withColumn("j", F.explode(F.expr("filter(sequence(0, 32), x -> x = 32 OR (shiftright(w, x) & 1) = 0)")))
        .select(
            F.expr("shiftleft(CAST(h AS BIGINT), 32) | w | (CASE WHEN j = 32 THEN 0L ELSE shiftleft(1L, j) END)").alias("key"),
            "fp",
            "rep",
            (F.col("j") == 32).alias("own"),
        )
    )
    variants = store(variants, "variants")
    sizes = variants.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("met")).where("n > 1 AND met")
    sizes = store(sizes, "buckets")
    cool = variants.join(sizes.where(F.col("n") <= hot_bucket).select("key"), "key", "left_semi")
    left = cool.where("own").select("key", F.col("fp").alias("fp1"), F.col("rep").alias("a"))
    right = cool.select("key", F.col("fp").alias("fp2"), F.col("rep").alias("b"), F.col("own").alias("own2"))
    found = (
        left.join(right, "key")
        .where(F.when(F.col("own2"), F.col("fp1") < F.col("fp2")).otherwise(F.lit(True)))
        .where(distance("fp1", "fp2") <= radius)
        .select("a", "b")
    )
    hot_keys = sizes.where(F.col("n") > hot_bucket).select("key")
    if not hot_keys.isEmpty():
        hot = variants.join(hot_keys, "key", "left_semi").select("fp", "rep").distinct()
        found = found.unionByName(ball_links(hot))
    found = store(found.distinct(), "links")
    discard(variants)
    discard(sizes)
    return found


def ball_links(nodes: DataFrame) -> DataFrame:
    """Edges joining exactly the fingerprints within 3 bits, linear in the number of fingerprints.

    Every fingerprint emits all words within 2 bits (2,081). Where a word has members within 1 bit, each of
    its members is within 1 + 2 bits of the smallest such member, so a star replaces all pairs. Two words
    at distance 3 share a word that is 1 bit from one and 2 from the other, so no link is missed. A bucket
    holds at most as many distinct fingerprints as a ball has words.
    """
    bit = "(CASE WHEN {0} = 64 THEN 0L ELSE shiftleft(1L, {0}) END)"
    balls = (
        nodes.withColumn("i", F.explode(F.expr("sequence(0, 64)")))
        .withColumn("j", F.explode(F.expr("sequence(i, 64)")))
        .where("i < j OR i = 64")
        .select(F.expr(f"fp ^ {bit.format('i')} ^ {bit.format('j')}").alias("word"), "rep", (F.col("j") == 64).alias("near"))
    )
    met = balls.groupBy("word").agg(F.min(F.when(F.col("near"), F.col("rep"))).alias("a"), F.collect_list("rep").alias("bs"))
    return met.where("a IS NOT NULL AND size(bs) > 1").select("a", F.explode("bs").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) for every row of ``docs``.

    component_id is the smallest id reachable over links of 3 or fewer differing bits, the document itself
    included; n_copies counts the rows with its very fingerprint. Null, empty and blank texts have
    fingerprint 0 and link like any other; repeated rows stay repeated; a row whose id is null takes part and
    gets the component of its fingerprint. Other columns are ignored; an empty table gives an empty result.
    """
    fps = store(fingerprints(docs, id_col, text_col, width), "fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    edges = links(nodes.where("rep IS NOT NULL").select("fp", "rep"))
    roots = components(edges).withColumnRenamed("node", "rep")
    groups = nodes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n_copies")
    groups = store(groups, "groups")
    discard(edges)
    # a fingerprint of more than one in HOT_SHARE rows, of which there are at most as many, is sent to all tasks
    hot = groups.where(F.col("n_copies") > max(1000, fps.count() // HOT_SHARE))
    dealt = fps.join(F.broadcast(hot), "fp", "left")
    own = dealt.where("n_copies IS NOT NULL").unionByName(
        dealt.where("n_copies IS NULL").select("doc_id", "fp").join(groups.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).drop("_fp")
    )
    return own.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
