"""Divergence of sources against plain arithmetic over whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from gneiss.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, slice string, seat int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, top=200):
    held, seen = defaultdict(Counter), defaultdict(Counter)
    for _, lang, source, text, *_ in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = TERM.findall(low)
        held[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in held}:
        kept = sorted((t for t, n in seen[lang].items() if n >= 3), key=str.encode)
        groups = {s: c for (x, s), c in held.items() if x == lang}

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s)
            tops = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, rows in (("pair", pairs), ("term", tops)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(rows, 1)}
    return out


def fixture():
    rng = random.Random(5)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Über", "ÜBER", "x’y", "a1b", "😀", "É"]
    docs = []
    for i in range(700):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None, "", "sé"])
        docs.append((i, lang, source, rng.choice(" \n-_") .join(rng.choice(words[: rng.choice([20, 306])]) for _ in range(rng.randint(0, 30))), "clash", 1))
    docs += [(800, "en", "none", None, "", 0), (801, "en", "only rare", "quux zyzzy", "", 0), (802, "fr", "alone", "un deux trois", "", 0)]
    docs += [(803, "it", "a", "uno", "", 0), (804, "it", "b", "due", "", 0), (None, "es", "x", "si", "", 0), (None, "es", "x", "si", "", 0), (None, "es", "y", "si no", "", 0)]
    return docs


@pytest.mark.parametrize("slice_terms, rounds", [(32_768, 32), (40, 2)])
def test_matches_plain_version(spark, slice_terms, rounds):
    docs = fixture()
    out = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(docs, SCHEMA), slice_terms=slice_terms, rounds=rounds).collect()]
    assert len(out) == len(set(out)) and set(out) == plain(docs)


def test_a_hot_source_many_ties_and_more_terms_than_are_ranked(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b for a in letters for b in letters][:450]
    docs = [(i, "en", "hot", " ".join(words), "", 0) for i in range(60)] + [(100 + i, "en", f"s{i}", words[i], "", 0) for i in range(9)]
    out = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(docs, SCHEMA), slice_terms=100).collect()]
    assert set(out) == plain(docs)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seats", [1, 2, 3, 4, 7, 10])
def test_every_pair_meets_once_and_no_seat_twice_in_a_round(spark, seats):
    rows = spark.createDataFrame([Row(seat=i, seats=seats, m=seats - 1 + seats % 2) for i in range(seats)])
    visits = rows.selectExpr("seat", f"explode({divergence._visits(0, 100)}) AS x").select("seat", "x.host", "x.round").collect()
    met = [(v.host, v.seat, v["round"]) for v in visits if v["round"] != divergence._RESIDENT]
    assert sorted(tuple(sorted(m[:2])) for m in met) == [(i, j) for i in range(seats) for j in range(i + 1, seats)]
    for r in {m[2] for m in met}:
        playing = [s for m in met if m[2] == r for s in m[:2]]
        assert len(playing) == len(set(playing))
    assert sum(v["round"] == divergence._RESIDENT for v in visits) == seats


def test_long_division_is_exact():
    counts = np.array([0, 1, 7, 10**12, 9 * 10**14], dtype=np.int64)
    total = 9 * 10**14 + 12345
    assert divergence.scaled(counts, total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


def test_vectors_round_trip_and_long_texts():
    idx, n = np.array([0, 5, 31_000]), np.array([1, 2**40, 3])
    back = divergence.unpacked(divergence.packed(idx, n))
    assert back[0].tolist() == idx.tolist() and back[1].tolist() == n.tolist()
    assert len(divergence.terms(b"A-b " * 500_000)) == 1_000_000
