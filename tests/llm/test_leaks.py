import random

import pytest

from gneiss.llm import leaks

SCHEMA = "doc_id long, text string, item_id long"


def plain_score(item: list[str], doc: list[str]) -> float:
    best, row = 0, [0] * (len(doc) + 1)
    for w in item:
        new = [0]
        for j, x in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (2 if x == w else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(item)) if item else 0.0


def fixture():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 6)))
    vocabulary = [word() for _ in range(500)]
    common = vocabulary[:6]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(20, 45)))) for i in range(15)] + [(50, "two words"), (51, ""), (52, None), (53, "Alone")]
    docs = []
    for d in range(80):
        body = text(rng.randint(5, 200))
        if d % 4 == 0:
            item = rng.choice(items[:15])[1].split()
            for _ in range(rng.randint(0, 9)):  # edited copies
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            at = rng.randrange(len(body))
            body[at:at] = item
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "x " * 30_000 + items[0][1].upper().replace(" ", ", ") + " y" * 30_000), (903, "has two, WORDS in it"), (904, "alone")]
    return docs, items


def test_matches_plain_alignment(spark):
    docs, items = fixture()
    found = leaks.find_leaks(spark.createDataFrame([(*r, 0) for r in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in found.collect()}
    expected = {}
    for d, t in docs:
        for i, s in items:
            a, b = leaks.words(s or ""), leaks.words(t or "")
            if a and b and len(b) < 1000 and (score := plain_score(a, b)) >= leaks.THRESHOLD:
                expected[d, i] = score
    assert got.pop((902, 0)) == 1.0
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in expected.items()}
    assert (903, 50) in got and (904, 53) in got


def test_a_passage_in_most_documents_is_still_found(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"own{i} {passage} end{i}", 0) for i in range(200)] + [(i, f"clean{i} text{i} w1 other{i}", 0) for i in range(200, 260)]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, passage), (2, "never seen words here at all")], "item_id long, text string")
    rows = leaks.find_leaks(d, b).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200)) and {(r.first_word, r.end_word) for r in rows} == {(1, 31)}
    assert sorted(r.doc_id for r in leaks.drop_leaked(d, b).collect()) == list(range(200, 260))


@pytest.mark.parametrize("copies", [9, 100, 5000])
def test_an_edited_copy_in_many_documents_is_found(spark, copies):
    item = [f"w{i}" for i in range(30)]
    fourth = [w if i % 4 != 3 else f"x{i}" for i, w in enumerate(item)]
    docs = [(i, f"own{i} {' '.join(fourth)} end{i}", 0) for i in range(copies)] + [(copies + i, f"clean{i} w1 w2 w3 other{i}", 0) for i in range(20)]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, round(r.score, 9)) for r in leaks.find_leaks(d, b).collect()} == {(i, 0.65) for i in range(copies)}
    assert sorted(r.doc_id for r in leaks.drop_leaked(d, b).collect()) == list(range(copies, copies + 20))


def test_bounds_lose_no_alignment():
    rng = random.Random(7)
    item = [f"w{i}" for i in range(30)]
    third = [w if i % 3 != 2 else "x" for i, w in enumerate(item)]  # no three words in a row are left
    apart = [x for w in item for x in (w, "x")]  # no two are
    assert min(plain_score(item, third), plain_score(item, apart)) >= 0.5
    letters = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for _ in range(60)]
    texts = [third, apart, ["y"] * 50 + apart + ["y"] * 50, *([rng.choice("abcdefghijk") for _ in range(rng.randint(1, 60))] for _ in range(60))]
    for threshold in (0.5, 0.7, 1.0):
        own = leaks.Items(list(range(61)), [" ".join(t) for t in [item, *letters]], threshold)
        for text in texts:
            scores = {n: plain_score(t, text) for n, t in enumerate([item, *letters])}
            assert {n: s for n, s, _, _ in leaks.matches(own, " ".join(text))} == {n: s for n, s in scores.items() if s >= threshold}


def test_blocks_of_items_give_the_same(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame([(*r, 0) for r in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: sorted(tuple(r) for r in leaks.find_leaks(d, b, **k).collect())
    assert rows(block_bytes=600) == rows()


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.2, 0.3])
def test_recall_of_edited_copies(spark, rate):
    """Each word of a copy is dropped, changed or doubled at a rate; every copy that scores enough is found."""
    rng = random.Random(int(rate * 100))
    _, items = fixture()
    items = items[:15]
    docs, expected, planted = [], set(), 60
    for d in range(planted):
        i, text = rng.choice(items)
        copy = [x for w in text.split() for x in (rng.choice([[], ["changed"], [w, w]]) if rng.random() < rate else [w])]
        body = [f"z{rng.randint(0, 99)}" for _ in range(80)]
        docs.append((d, " ".join(body[:40] + copy + body[40:]), 0))
        if plain_score(leaks.words(text), leaks.words(docs[-1][1])) >= leaks.THRESHOLD:
            expected.add((d, i))
    found = leaks.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert expected <= {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(expected) >= (planted if rate <= 0.2 else 0.8 * planted)


def test_an_item_of_one_repeated_word_and_a_bounded_block(spark, monkeypatch):
    items = [(1, "ha " * 400), (2, "one two three four five"), (3, "one two three four six")]
    docs = [(1, "ha " * 30_000, 0), (2, "ha ha", 0), (3, "so one two three four five", 0)]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in leaks.find_leaks(d, b).collect())
    whole = rows()
    assert whole == [(1, 1, 1.0), (3, 2, 1.0), (3, 3, 0.8)]
    monkeypatch.setattr(leaks, "MOST_BYTES", 100)
    assert rows() == whole


def test_many_blocks_leave_the_same_documents(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame([(*r, 0) for r in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leaks.drop_leaked(d, b).collect()), key=repr)
    assert len(whole) < len(docs)
    made, spread = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: made.append(x) or spread(x))
    left = leaks.drop_leaked(d, b, block_bytes=sum(len(t or "") for _, t in items) // 10)
    assert sorted(map(tuple, left.collect()), key=repr) == whole
    assert len([x for x in made if isinstance(x, leaks.Items)]) >= 8
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("clean(") <= 2  # one block in a worker, named in the operator and the filter


def test_empty_tables(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame([(*r, 0) for r in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.find_leaks(d.where("false"), b).collect() == []
    assert leaks.find_leaks(d, b.where("false")).collect() == []
    assert leaks.drop_leaked(d, b.where("false")).count() == len(docs)
