import hashlib
import random
import re

import xxhash

from gneiss.llm import simhash
from gneiss.llm.common import components

SCHEMA = "doc_id long, text string, component_id string"


def plain_fingerprint(text: str) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict[int, int]) -> dict[int, int]:
    out = {}
    for start in sorted(fps):
        if start in out:
            continue
        todo = [start]
        while todo:
            d = todo.pop()
            if d not in out:
                out[d] = start
                todo += [e for e in fps if e not in out and (fps[d] ^ fps[e]).bit_count() <= 3]
    return out


def texts() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 120):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "A"), (204, "a"), (205, "É b C"), (206, "é b c"), (207, "x y " * 40_000), (208, "X\ty\n" * 40_000)]
    return [(*r, "clash") for r in rows]


def test_matches_plain_version(spark):
    rows = texts()
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {d: plain_fingerprint(t) for d, t, _ in rows}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == plain_components(fps)
    assert all(len(r.fingerprint) == 16 for r in got.values())


def test_hot_buckets_give_the_same_groups(spark):
    rng = random.Random(5)
    words = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(30):
            x = center
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            words.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in words]
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, rep long")
    expected = {(i, j) for i, x in enumerate(signed) for j, y in enumerate(signed) if i < j and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}
    cool = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(nodes).collect()}
    assert cool == expected
    roots = lambda edges: {(r.node, r.root) for r in components(edges).collect()}
    hot = simhash.links(nodes, hot_bucket=2)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in hot.collect()} <= expected
    assert roots(hot) == roots(spark.createDataFrame(sorted(expected), "a long, b long"))


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d", ""), (5, "a b c d", ""), (5, "a b c d", ""), (9, None, "")]
    got = sorted((r.doc_id or -1, r.component_id, r.n_copies) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 5, 3), (5, 5, 3), (5, 5, 3), (9, 9, 1)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_fingerprint_of_very_many_rows(spark):
    rows = [(i, None if i % 2 else f"a b c {i}", "") for i in range(4000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("fingerprint = '0000000000000000'").collect()
    assert len(got) == 2000 and {(r.component_id, r.n_copies) for r in got} == {(1, 2000)}
