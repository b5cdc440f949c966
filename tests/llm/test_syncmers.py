import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.llm import syncmers

SCHEMA = "doc_id long, text string, next string, hashes string"


def plain_anchors(spark, words, k=syncmers.K, s=syncmers.S):
    """Positions of closed syncmers, from the hashes of word pairs alone."""
    if len(words) < k:
        return [0] if words else []
    pairs = spark.createDataFrame([(i, words[i], words[i + 1]) for i in range(len(words) - 1)], "i int, a string, b string")
    h = {r.i: r.h for r in pairs.select("i", F.xxhash64("a", "b").alias("h")).collect()}
    out = []
    for i in range(len(words) - k + 1):
        inner = [h[i + j] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_match_plain_version(spark):
    rng = random.Random(1)
    words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 30)) for _ in range(300)]
    got = spark.createDataFrame([(" \n".join(words),)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).first().a
    assert [x.pos for x in got] == plain_anchors(spark, words)
    short = spark.createDataFrame([("one two",), ("",), (" \t ",)], "t string").select(F.size(syncmers.anchors(F.col("t"))).alias("n")).collect()
    assert [r.n for r in short] == [1, 0, 0]


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(2)
    body = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    a, b = " ".join(body), " ".join([f"x{i}" for i in range(17)] + body)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.matching_positions(*(syncmers.first_anchors(syncmers.anchors(F.col(c))) for c in "ab")).alias("m")).first().m
    assert len(row) == len(plain_anchors(spark, body)) and {x.pos_b - x.pos_a for x in row} == {17}


def plain_edited(rows):
    out = {}
    order = sorted(rows)
    for n, (d, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = t[: len(t) - half] + after[:half]
    return out


def plain_likeness(a, b, k=syncmers.K):
    """From (hash, pos) lists: tokens covered by shared anchors, over tokens covered by any."""
    once = lambda xs: {h: min(p for g, p in xs if g == h) for h, _ in xs}
    cover = lambda ps: len({t for p in ps for t in range(p, p + k)})
    a, b = once(a), once(b)
    if not a and not b:
        return 1.0
    shared = a.keys() & b.keys()
    return (cover(a[h] for h in shared) + cover(b[h] for h in shared)) / (cover(a.values()) + cover(b.values()))


def read(fingerprint):
    return [(int(x.split("@")[0], 16), int(x.split("@")[1])) for x in fingerprint.split()]


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_edited_texts(spark, bucket, monkeypatch):
    monkeypatch.setattr(syncmers.with_next, "__defaults__", (bucket, syncmers.BROADCAST_BUCKETS if bucket > 1 else 0))
    rng = random.Random(3)
    text = lambda: " ".join(f"é{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 200)))
    rows = [(i * i * 7, text()) for i in range(40)] + [(99_991, None), (99_992, ""), (99_993, "ab"), (99_994, "😀" * 31), (10**12, text())]
    rows += [(-(1 << 63) + 5, text()), ((1 << 63) - 1, text()), ((1 << 63) - 2, "aa bb cc " * 40)]
    got = {r.doc_id: r for r in syncmers.compare_documents(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    order = sorted(dict(rows))
    for n, (d, e) in enumerate(plain_edited(rows).items()):
        assert (got[d].edited_sha256, got[d].n_chars) == (hashlib.sha256(e.encode()).hexdigest(), len(dict(rows)[d] or "")), d
        own, after = read(got[d].fingerprint), read(got[order[(n + 1) % len(order)]].fingerprint)
        assert got[d].near_edited == pytest.approx(plain_likeness(own, read(got[d].edited_fingerprint)))
        assert got[d].near_next == pytest.approx(plain_likeness(own, after))
    big = [got[d] for d, t in rows if t and len(t) > 400 and t[0] == "é"]
    assert all(0.35 < r.near_edited < 0.7 and r.near_next < 0.1 for r in big)


def like(spark, a, b):
    sides = [syncmers.first_anchors(syncmers.anchors(F.col(c))) for c in "ab"]
    return spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.likeness(*sides).alias("x")).first().x


def test_text_without_spaces_is_cut_free_of_context(spark):
    rng = random.Random(8)
    text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000))
    assert like(spark, text, text[:700] + "字" + text[700:]) > 0.98
    assert like(spark, text, "字" + text) > 0.98
    assert like(spark, text[:1000], text[1000:]) < 0.02


def test_a_short_shared_passage_of_long_texts_counts(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared, a, b = words(60), words(20_000), words(20_000)
    x = like(spark, " ".join(a[:9000] + shared + a[9000:]), " ".join(b[:300] + shared + b[300:]))
    assert 0.002 < x < 0.004
    a[500] = "changed"
    assert 0.999 < like(spark, " ".join(a), " ".join(a[:500] + ["again"] + a[501:])) < 1


def test_equal_texts_repeats_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(90))
    rows = [(1, t, "", ""), (2, t, "", ""), (2, t, "", ""), (None, t, "", "")]
    got = syncmers.compare_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 1 and all(r.near_next == 1.0 for r in got)
    one = syncmers.compare_documents(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert one.near_next == 1.0
    assert syncmers.compare_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_without_spaces(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(300_000))
    got = syncmers.compare_documents(spark.createDataFrame([(1, t, "", "")], SCHEMA)).first()
    assert got.n_chars == 300_000 and len(got.fingerprint) > 0
