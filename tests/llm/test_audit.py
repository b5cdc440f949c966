"""Filter interaction audit against a plain version: every order of the filters run over lists."""

import random
from collections import defaultdict
from itertools import permutations

import pytest

from gneiss.llm import audit

DOCS, LABELS = "doc_id long, text string, source string, mask string, kind int", "doc_id long, quality int, toxic int"


def plain_fails(doc_id, text, least):
    words, chars = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" "), len(text)
    words = [w for w in words if w]
    fails = ""
    fails += "A" if len(words) < 200 else ""
    fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    fails += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * chars else ""
    fails += "D" if any(c in "#$%&*|" for c in text) else ""
    return fails + ("E" if doc_id is not None and least[text] < doc_id else "")


def plain(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, s, *_ in docs:
        parts[s or ""].append((i, plain_fails(i, t or "", least)))
    out = set()
    for part, own in parts.items():
        removed_by, rows = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                gone = [d for d in own if d not in left]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] and any(x in d[1] for x in order[: step - 1]) for d in own)
                assert redundant <= len(gone)
                removed_by[f] += len(here)
                unique = sum(d[1] == f for d in own)
                rows.append((part, order, step, len(left), len(here), redundant, unique, sum(d[0] in good for d in here), sum(d[0] in toxic for d in here), f))
        out |= {(*r[:-1], removed_by[r[-1]]) for r in rows}
    return out


def fixture():
    rng = random.Random(3)
    texts = []
    for k in range(40):
        words = [rng.choice(["Alpha", "beta", "gamma", "ünïk", f"w{rng.random()}"]) for _ in range(rng.choice([0, 3, 150, 199, 200, 260]))]
        texts.append(rng.choice([" ", "\n", "\x0b"]).join(words) + rng.choice(["", "", "#", "|", "*"]))
    texts += [None, "", " ", "A" * 3 + "b" * 147, "  x y"]
    docs = [(i * 7 % 1000, rng.choice(texts), rng.choice(["a", "b", None, ""]), "clash", 1) for i in range(400)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1000, 2)] + [(None, 1, 1), (14, 1, 0), (14, 0, 1)]
    return docs, labels


@pytest.fixture
def many_tasks(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("13", "false")):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def got(spark, docs, labels):
    out = audit.audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return [tuple(r) for r in out.collect()]


def test_matches_plain_version(spark):
    docs, labels = fixture()
    rows = got(spark, docs, labels)
    assert len(rows) == 3 * 600 and set(rows) == plain(docs, labels)


def test_copies_over_many_tasks(spark, many_tasks):
    docs = [(i, "one text that very many documents hold", "hot", "", 0) for i in range(3000)] + [(5000 + i, f"own {i}", "b", "", 0) for i in range(300)]
    rows = got(spark, docs, [])
    first = {(r[0], r[1], r[2]): r for r in rows}
    assert first["hot", "EABCD", 1][3:5] == (1, 2999) and first["b", "EABCD", 1][3:5] == (300, 0)
    assert set(rows) == plain(docs, [])


def test_repeats_null_ids_and_empty_tables(spark, many_tasks):
    docs = [(None, "same", "a", "", 0), (None, "same", "a", "", 0), (3, "same", "a", "", 0), (3, "same", "a", "", 0), (2, "same", "a", "", 0), (2, "same", None, "", 0)]
    docs += [(None, None, None, None, None), (1, None, None, None, None), (2, "", "a", None, None)]
    masks = audit.failure_masks(spark.createDataFrame(docs, DOCS))
    repeated = sorted((r.doc_id, r.part) for r in masks.collect() if r.mask & audit.REPEATED)
    assert repeated == [(2, "a"), (3, "a"), (3, "a")]
    assert masks.count() == len(docs)
    assert got(spark, [], [(1, 1, 1)]) == []


def test_texts_of_one_fingerprint_are_told_apart(spark, many_tasks):
    rows = spark.createDataFrame([(1, bytearray(f"text {i % 3}".encode()), i, "a") for i in range(500)], "fp long, text binary, doc_id long, part string")
    out = audit._compared(rows).collect()
    least = {}
    for r in out:
        if r.kind == audit._SUMMARY:
            least[bytes(r.digest)] = min(r.doc_id, least.get(bytes(r.digest), r.doc_id))
    new = [r.doc_id for r in out if (r.kind == audit._DECIDED and not r["mask"] & audit.REPEATED) or (r.kind == audit._PENDING and least.get(bytes(r.digest), r.doc_id) >= r.doc_id)]
    assert sorted(new) == [0, 1, 2]


def test_very_long_text():
    text = ("Word " * 300_000 + "é").encode()
    assert audit.own_failures(text) == 2 + 4
    assert audit.own_failures(b"") == 1
