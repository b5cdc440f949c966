import random
import re

import numpy as np
import pytest

from gneiss.llm import similar

SCHEMA = "doc_id long, text string, rep string, component_id string"


def plain_set(text, width=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_groups(rows, similarity=0.8):
    sets = {d: plain_set(t) for d, t in rows}
    alike = lambda a, b: len(a & b) >= similarity * len(a | b)
    out = {}
    for start in sorted(sets):
        if start in out:
            continue
        todo = [start]
        while todo:
            d = todo.pop()
            if d not in out:
                out[d] = start
                todo += [e for e in sets if e not in out and alike(sets[d], sets[e])]
    return out


def near_texts(n_base=25, copies=14, seed=3):
    """Texts, and copies with no or few edits."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    rows = []
    for b in range(n_base):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(base) // 100)])):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words)))
    return rows


def test_shingle_sets_match_plain_ones():
    for text in ["", "a", "a b c d", "a b c d e", "A b\tC d e f g", "x " * 1000, " ".join(map(str, range(3000))), "é É ü" * 3]:
        assert len(similar.shingle_set(text.encode())) == len(plain_set(text)), text
    a, b = " ".join(map(str, range(500))), " ".join(map(str, range(20, 520)))
    shared = np.intersect1d(similar.shingle_set(a.encode()), similar.shingle_set(b.encode()))
    assert len(shared) == len(plain_set(a) & plain_set(b))


def test_fingerprint_matches_plain_counts():
    shingles = similar.shingle_set(" ".join(map(str, range(20_000))).encode())
    layout = similar.Layout.for_texts(10**6)
    got = similar.fingerprint(shingles, layout)
    assert len(got) == len(layout.longs) == 7 and layout.to_a_long == 2
    with np.errstate(over="ignore"):
        for k in (0, 5):
            words = similar._mixed(shingles + np.uint64((k + 1) * similar._STEP & (1 << 64) - 1))
            for bit in (0, 7, 8, 31, 55):
                ones = int(((words >> np.uint64(bit)) & np.uint64(1)).sum())
                assert (got[k] >> bit & 1) == (2 * ones > len(shingles))


def test_groups_match_plain_version(spark):
    rows = near_texts() + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A"), (1004, "a"), (1005, "y z " * 30_000), (1006, "Y z " * 30_000)]
    expected = plain_groups(rows)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    kept = similar.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_large_groups_and_chains_lose_no_link(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(300)]
    rows = []
    for i in range(150):  # a chain: each text is one word longer, so far ones have little in common
        rows.append((i, " ".join(base[: 150 + i] + [f"t{i}"])))
    for i in range(150):  # a cluster around one text
        words = [f"c{j}" for j in range(300)]
        words[rng.randrange(300)] = f"x{i}"
        rows.append((1000 + i, " ".join(words)))
    got = {r.component_id for r in similar.near_groups(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert got == set(plain_groups(rows).values())


def test_pairs_at_the_threshold_are_found(spark):
    """Recall on pairs with similarities from 0.8 to 0.9, a block or single words changed."""
    rng = random.Random(5)
    rows, n = [], 240
    for p in range(n):
        base = [f"w{rng.randint(0, 50_000)}" for _ in range(300)]
        edited = list(base)
        if p % 2:
            edited[100 : 100 + 26] = [f"b{p}-{i}" for i in range(26)]
        else:
            for i in rng.sample(range(10, 290), 5):
                edited[i] = f"s{p}-{i}"
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(edited))]
    sets = {d: plain_set(t) for d, t in rows}
    shares = [len(sets[2 * p] & sets[2 * p + 1]) / len(sets[2 * p] | sets[2 * p + 1]) for p in range(n)]
    assert all(0.8 <= s < 0.9 for s in shares)
    kept = {r.doc_id for r in similar.drop_near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert all(2 * p in kept for p in range(n))
    assert sum(2 * p + 1 not in kept for p in range(n)) >= 0.9 * n


@pytest.mark.parametrize("size, share", [(4, 1.0), (12, 1.0), (20, 1.0), (32, 1.0), (48, 0.9), (80, 0.9), (160, 0.9), (400, 0.9)])
def test_recall_at_exactly_the_threshold_by_size(spark, size, share):
    """Of two texts one is the other less its end, so that four fifths of the longer one's shingles are shared."""
    rng = random.Random(size)
    common = [f"c{i}" for i in range(4)]  # all texts begin alike: their common shingles are no reason to meet
    rows, n = [], 150
    for p in range(n):
        words = common + [f"w{rng.randint(0, 10**6)}" for _ in range(size * 5 // 4)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(words[: size + 4]))]
    assert {len(plain_set(t)) for _, t in rows} == {size, size * 5 // 4}
    kept = {r.doc_id for r in similar.drop_near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert {d for d in range(2 * n) if d % 2 == 0} <= kept
    assert sum(2 * p + 1 not in kept for p in range(n)) >= share * n


def test_wider_pieces_find_the_same_groups(spark, monkeypatch):
    rows = near_texts(6, 8)
    wide = similar.Layout(34, 30)
    monkeypatch.setattr(similar.Layout, "for_texts", classmethod(lambda cls, n: wide))
    kept = similar.drop_near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_groups(rows).values()))


def test_layouts_follow_the_number_of_texts():
    small, large = similar.Layout.for_texts(4_000_000), similar.Layout.for_texts(250_000_000)
    assert (small.bits, small.pieces, large.bits) == (28, 14, 34)
    for n in (10**6, 10**8, 10**10):
        layout = similar.Layout.for_texts(n)
        assert n * (layout.bits + 1) / 2**layout.bits <= 1 and layout.pieces <= layout.to_a_long * len(layout.longs)


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f", "", ""), (5, "a b c d e f", "", ""), (5, "a b c d e f", "", ""), (9, "A b c  d e f", "", ""), (7, None, "", "")]
    kept = similar.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 5, 5, 7]
    assert similar.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs_across_groups_are_made_only_where_they_may_be_alike(spark, monkeypatch):
    """Copies of one text with too many edits of their own share keys with all the others, and are like none."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 5, 6])):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    asked, plain = [], similar.confirmed
    monkeypatch.setattr(similar, "confirmed", lambda pairs, *a: asked.append(pairs.count()) or plain(pairs, *a))
    groups = similar.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.rep: r.component_id for r in groups.collect()} == plain_groups(rows)
    assert asked[1] < 160  # of some thousand pairs of a key across groups


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n, own in ((5, 0), (40, 3), (300, 30), (5000, 4000)):
        a, b = (np.unique(np.concatenate([np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rng.integers(0, 1 << 63, own).astype(np.uint64)])) for _ in range(2))
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(similar.parities(a), similar.parities(b)))
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0) == (own > 0)
    assert len(similar.parities(np.zeros(0, dtype=np.uint64))) == len(similar.PARITIES)
