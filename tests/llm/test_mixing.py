"""Mixing against a plain water filling, and what any mix must keep to."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from gneiss.llm import mixing

SCHEMA = "doc_id long, text string, source string, rank string, size string"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By the contract's words: share by weight, stop at the limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, Fraction(0)), Fraction(sum(sizes.values())), set(order)
    while rest and open_:
        level = rest / sum(w[s] for s in open_)
        for s in open_:
            target[s] += level * w[s]
        rest = Fraction(0)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                open_.discard(s)
    return {s: float(t) for s, t in target.items()}


def fixture(seed=1, n=1500):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "c", "tiny", None, "", "\U0001f600", "￿"])
        if source == "tiny" and rng.random() < 0.95:
            source = "b"
        docs.append((i * 3, rng.choice([" ", "\n", "  "]).join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 60, 300]))), source, "clash", "clash"))
    return docs + [(9001, "w " * 20_000, "c", "", ""), (9002, None, "c", "", ""), (9003, "none\x1fof it", "only", "", ""), (9004, "", "empty", "", "")]


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def taken(mix):
    targets = {r["rank"]: r for r in mix.targets.collect()}
    return [(r.doc_id, r["size"], r.taken, targets[r["rank"]]) for r in mix.taken().collect()]


def test_targets_sizes_and_what_is_taken(spark):
    docs = fixture()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[2]] += len(words(d[1]))
    rows = taken(mixing.plan_mix(spark.createDataFrame(docs, SCHEMA)))
    assert sorted(r[:2] for r in rows) == sorted((d[0], len(words(d[1]))) for d in docs)
    expected, by_source = plain_targets(sizes), defaultdict(int)
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))
    for doc_id, size, n, target in rows:
        assert 0 <= n <= 3 * size
        assert target["source_size"] == sizes[target["source"]] and target["target"] == pytest.approx(expected[target["source"]], abs=1e-6)
        by_source[target["source"]] += n
    for source, n in by_source.items():
        assert abs(n - expected[source]) <= 2 * mixing.BLOCK
    assert by_source["tiny"] == 3 * sizes["tiny"]


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 7, 100, 10_000, 10**9]) for i in range(rng.randint(1, 14))} | ({None: 5} if seed % 2 else {})
    out = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert out == pytest.approx(plain_targets(sizes), rel=1e-12)


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = fixture(2, 400)
    first = sorted(r[:3] for r in taken(mixing.plan_mix(spark.createDataFrame(docs, SCHEMA))))
    again = sorted(r[:3] for r in taken(mixing.plan_mix(spark.createDataFrame(docs[::-1], SCHEMA).repartition(7))))
    assert first == again
    other = sorted(r[:3] for r in taken(mixing.plan_mix(spark.createDataFrame(docs, SCHEMA), seed=7)))
    assert other != first


def test_shards_are_full_and_their_texts_are_what_is_taken(spark):
    docs = fixture(3, 300)
    df = spark.createDataFrame(docs, SCHEMA)
    mix = mixing.plan_mix(df, block=16, shard=100)
    slots = mix.slots.collect()
    places = defaultdict(set)
    for r in slots:
        places[r.shard].add(r.slot)
    full = [places[s] == set(range(100)) for s in sorted(places)]
    assert all(full[:-1]) and sum(map(len, places.values())) == len(slots)
    blocks = mixing.mixed_blocks(df, block=16, shard=100).collect()
    assert len(blocks) == len(slots)
    n_words = Counter()
    for b in blocks:
        n_words[b.source] += len(words(b.text))
        assert len(words(b.text)) <= 16
    by_source = Counter()
    for _, _, n, target in taken(mix):
        by_source[target["source"]] += n
    assert +n_words == +by_source
    # shards draw their own counts: they differ, around the shares of all slots
    ranks = [Counter(r["rank"] for r in slots if r.shard == s)[mix.targets.where("source = 'hot'").first()["rank"]] for s in range(len(full) - 1)]
    assert len(set(ranks)) > 1


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 64, 65, 1000):
        found = [mixing.permuted(np.arange(n), n, key).tolist() for key in (1, 2)]
        assert sorted(found[0]) == list(range(n)) == sorted(found[1])
        assert n < 64 or found[0] != found[1]


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c", "x", "", ""), (None, "a b c", "x", "", ""), (1, "d e", "x", "", ""), (1, "d e", "x", "", ""), (1, "f", None, "", "")]
    out = taken(mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)))
    assert len(out) == 5 and sum(r[1] for r in out) == 11
    assert all(r[2] <= 3 * r[1] for r in out)
    assert taken(mixing.plan_mix(spark.createDataFrame([], SCHEMA))) == []
    only_empty = [(1, "", "x", "", ""), (2, None, None, "", "")]
    assert sorted(r[:3] for r in taken(mixing.plan_mix(spark.createDataFrame(only_empty, SCHEMA)))) == [(1, 0, 0), (2, 0, 0)]
