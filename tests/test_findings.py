"""Small inputs on which queries once went wrong."""

from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gneiss import catalog
from gneiss.functions import ratio
from gneiss.operators import matching
from gneiss.sources import files
from gneiss.streaming import stateful
from gneiss.workloads import finance


def written(df, folder, table):
    df.write.parquet(f"{folder}/{table}.parquet")


def test_halves_of_a_unit_are_rounded_as_prices_add_up_in_order(spark, tmp_path):
    prices = [3.0, 1e16, -1e16]  # 4 in this order, 3 in the other
    rows = [(i, 7, "P", p, "2-HIGH") for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    written(df.orderBy(F.desc("o_orderkey")).coalesce(1), tmp_path, "orders")
    (row,) = catalog.queries()["cancel_all_for_lead"](spark, str(tmp_path)).collect()
    total = 0.0
    for p in prices:
        total += p
    assert (row.cancelled, row.total) == (3, total)


def test_vectors_keep_the_sign_of_what_is_rounded_to_nothing(spark, tmp_path):
    written(spark.createDataFrame([(1, [-1e-7, 1e-7, 0.0, -2e-6, -0.0078125])], "vec_id long, embedding array<float>"), tmp_path, "embeddings")
    (row,) = catalog.queries()["truncate_vector"](spark, str(tmp_path)).collect()
    assert row["head"] == [0.0, 0.0, 0.0, -2e-6, -0.007813]
    assert [math.copysign(1, x) for x in row["head"]] == [-1, 1, 1, -1, -1]


class Held:
    """A value or a list of one key, as the state store has it."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held if isinstance(self.held, tuple) else iter(self.held)

    def update(self, value):
        self.held = value

    put = update

    def appendList(self, rows):
        self.held = [*(self.held or []), *rows]

    def clear(self):
        self.held = None


class Store:
    """Timers and state of one key, and the watermark."""

    def __init__(self):
        self.timers, self.passed = [], 0

    def getValueState(self, *_):
        return Held()

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_rows_that_wait_share_a_timer(spark):
    store = Store()
    p = stateful.InOrder("k", (0,), "n bigint", lambda state, ms, value: ((state[0] + 1,), (state[0],)), ["n"])
    p.init(store)
    times = pd.Series(pd.to_datetime([i * 1000 for i in range(50, 0, -1)], unit="ms"))
    list(p.handleInputRows(("=1",), iter([pd.DataFrame({"ts": times, "value": ["x"] * 50})]), None))
    assert store.timers == [1000]
    got = []
    for store.passed in (20_000, 60_000):
        got += [n for out in p.handleExpiredTimer(("=1",), store, None) for n in out["n"]]
    assert got == list(range(50)) and store.timers == [1000, 21_000]


def test_files_are_not_listed_by_the_driver_and_keep_odd_names(spark, tmp_path):
    rows = [("a/b", "x=1 %2F/é.pdf", "uno\n"), (None, None, "dos"), ("", "", ""), ("a/b", "dos", "1"), ("a/b", "dos", "2"), ("a/b", "dos", "2")]
    path = f"file://{tmp_path}/f"
    files.write_files(spark.createDataFrame(rows, "folder string, name string, text string"), path)
    listed = files.list_files(spark, path)
    assert not listed.inputFiles()  # Spark's own listing names each of them here
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.folder, r.name, r["size"]) for r in listed.collect()), key=key) == sorted(((f, n, len(t.encode()) + 1) for f, n, t in rows), key=key)
    assert sorted(((r.folder, r.name, r.text) for r in files.read_texts(spark, path).collect()), key=key) == sorted(rows, key=key)


def test_copies_wait_in_line_and_are_matched_as_all_pairs_would(spark):
    rng = random.Random(3)
    texts = ["solado gres", "solado Gres", "solado gris", "gres solado", "muro de gres", "muro del gres", "", None]
    golden, found = ([(b, i, rng.choice(texts)) for b in (1, 2) for i in rng.sample(range(1000), 60)] for _ in range(2))
    schema = "doc_id long, seq long, description string"
    got = matching.greedy_alike(spark.createDataFrame(golden, schema), spark.createDataFrame(found, schema), "doc_id", 0.7).collect()
    want, taken = set(), set()
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    for b, g, text in sorted(golden, key=lambda r: r[:2]):
        near = [(-ratio(text, other), f) for c, f, other in found if c == b and text and other and (b, f) not in taken and ratio(text, other) >= 0.7]
        if near:
            r, f = min(near)
            taken.add((b, f))
            want.add((b, g, f, -r))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_more_lines_make_more_tasks_of_running_cost(spark, sf, monkeypatch):
    monkeypatch.setattr(finance, "ROWS_A_TASK", 500)
    assert catalog.queries()["win_running_cost"](spark, sf).rdd.getNumPartitions() > 10


def test_fragments_compare_each_pair_of_texts_once(spark, monkeypatch):
    """Many rows of few descriptions: the ratio is asked for each pair of texts, and no pair of rows is made twice."""
    from gneiss.plans import retrieval

    asked = spark.sparkContext.accumulator(0)

    def counted(a, b):
        def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            asked.add(len(x))
            return pd.Series([1.0] * len(x))

        return F.pandas_udf(ratio, "double")(a, b)

    monkeypatch.setattr(retrieval, "hybrid_similarity", counted)
    lines = spark.range(30).selectExpr("id AS line_id", "'02.1' AS code", "'C02 Baños' AS chapter", "concat('t', id % 2) AS description", "array('a', 'b') AS topics")
    tags = "array('chapter_code:2', 'chapter_code:02', 'chapter:baños', 'chapter:c02', 'a', 'B', 'cross_chapter:' || (id % 2 = 0))"
    fragments = spark.range(40).selectExpr("id AS fragment_id", "'golden' AS status", f"{tags} AS tags", "concat('t', id % 3) AS description", "timestamp '2025-12-01' AS at", "true AS is_baseline")
    got = [tuple(r)[:2] for r in retrieval.retrieve_fragments(lines, fragments, "2026-01-01").collect()]
    assert len(got) == len(set(got)) == 30 * 40
    assert asked.value == 2 * 3


def test_items_read_pages_once(spark):
    """Heads, descriptions and quantities come from one pass; the plan had one each, joined."""
    from gneiss.plans import layout

    text = "C01.01 Partida m2 UNO\nTexto.\n2,50\n2,50\nC01.02 Partida ml DOS\nC01.03 Partida ud TRES\n5,00\nC01.04 Partida ud CUATRO\n5,00\n1,00"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "C01.01 Partida m2 UNO\n5,00"), (3, 1, None)], "doc_id long, page_no int, text string")
    want = [(1, "C01.01", 5.0), (1, "C01.02", None), (1, "C01.03", -1.0), (1, "C01.04", 1.0), (2, "C01.01", 5.0)]
    for described in (True, False):
        items = layout.extract_items(pages, -1.0, described)
        assert items._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
        assert [(r.doc_id, r.code, r.quantity) for r in items.orderBy("doc_id", "at").collect()] == want
    assert [r.description for r in layout.extract_items(pages).orderBy("doc_id", "at").collect()] == ["Texto.", None, None, None, None]


def test_blocks_of_many_pairs_are_those_of_difflib():
    """Ratios were worked out pair by pair in plain Python."""
    rng = random.Random(5)
    texts = ["", "ñ", "\0a\0", *("".join(rng.choice("abcé🙂 ") for _ in range(rng.choice((1, 5, 30, 90, 199, 200, 260)))) for _ in range(60))]
    a, b = (np.array([rng.randrange(len(texts)) for _ in range(900)]) for _ in range(2))
    want = np.array([SequenceMatcher(None, texts[x], texts[y]).ratio() for x, y in zip(a, b)])
    assert (ratio.ratios(texts, a, b) == want).all()
    for least in (0.3, 0.55):
        got = ratio.ratios(texts, a, b, least=least)
        assert ((got >= least) == (want >= least)).all() and (got[want >= least] == want[want >= least]).all()
    codes = ratio.flat_codes(texts)
    most = ratio.bounds(codes, 20)
    assert all(most[x, y - 20] >= w - 1e-9 for x, y, w in zip(a, b, want) if x < 20 <= y)


def test_texts_of_a_block_are_compared_in_parts(spark, monkeypatch):
    """Rows met on single characters, so that two texts met, and were told apart, at each letter that both had."""
    monkeypatch.setattr(matching, "GOLDEN_TEXTS", 3)
    monkeypatch.setattr(matching, "FOUND_TEXTS", 4)
    sizes = spark.sparkContext.accumulator(0)
    plain = matching.bounds

    def counted(codes, n):
        sizes.add(n * (len(codes[2]) - n))
        return plain(codes, n)

    monkeypatch.setattr(matching, "bounds", counted)
    schema = "doc_id long, seq long, description string"
    golden, found = ([(i % 2, i, f"solado de gres {i % 7}{side}") for i in range(40)] for side in ("a", "b"))
    got = matching.similar_pairs(spark.createDataFrame(golden, schema), spark.createDataFrame(found, schema), "doc_id", 0.9).collect()
    ratio_of = lambda x, y: SequenceMatcher(None, x, y).ratio()
    assert {(r.doc_id, r.golden_seq, r.found_seq) for r in got} == {(d, i, j) for d, i, x in golden for e, j, y in found if d == e and ratio_of(x, y) >= 0.9}
    assert sizes.value == 2 * 20 * 20  # each pair of a block is looked at once


def test_kinds_of_lines_and_fragments_meet_once(spark, monkeypatch):
    """Copies were met, compared and filtered row by row; what they count, their times and baselines are still their own."""
    from gneiss.plans import retrieval

    made = []
    plain = retrieval.applying
    monkeypatch.setattr(retrieval, "applying", lambda *sides: made.append(plain(*sides)) or made[-1])
    lines = [(i, "02.1" if i % 2 else "C", "C02 Baños", "solado de gres", None) for i in range(6)] + [(9, None, None, "muro", ["x"]), (None, "02.1", "", "muro", []), (8, "02.1", "", None, [])]
    day = lambda d: pd.Timestamp(2025, 12, d).to_pydatetime()
    fragments = [(i, "golden", ["chapter:baños"], " solado de gres" if i % 2 else "solado de gres", day(1 + i % 3), None) for i in range(8)]
    fragments += [(20 + i, "golden", ["cross_chapter:true"], "muro", day(1), bool(i)) for i in range(2)] + [(30, "golden", None, "solado de gres", day(1), True), (None, "golden", ["chapter:baños"], "x", day(1), True)]
    got = retrieval.retrieve_fragments(
        spark.createDataFrame(lines, "line_id long, code string, chapter string, description string, topics array<string>"),
        spark.createDataFrame(fragments, "fragment_id long, status string, tags array<string>, description string, at timestamp, is_baseline boolean"),
        "2026-01-01",
    ).collect()
    order = sorted(range(8), key=lambda i: (-(1 + i % 3), i))
    want = {(line, f, n) for line in range(6) for n, f in enumerate(order, 1)} | {(9, 20, 1), (9, 21, 2)}
    assert {(r.line_id, r.fragment_id, r["rank"]) for r in got} == want and len(got) == len(want)
    assert made[0].count() == 2 * 2 + 1  # two kinds of lines meet two of fragments, the wall one


def test_pages_are_cut_into_items_before_they_are_dealt(spark):
    """Each line was shuffled and sorted, items were shuffled once more, and documents were profiled again for each route."""
    from gneiss.plans import layout

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    front = ["C01 Capítulo UNO\nC01.01 Partida m2 A\nTexto.\nC01.02 Partida ud B\nTexto sin punto", "y su final.\nC01.03 Partida ml C\nC02 Capítulo DOS", "C02.01 Partida h D\nTexto."]
    back = ["3,00\nC01-01\n1,00 m2\n2,00 m2\nC01-02", "4,00 ud\nC01-03\n5,00\nC01-01", "7,00\nC02-01"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(front + back, 1)], "doc_id long, page_no int, text string")
    assert plan(layout.extract_items(pages)).count("Exchange ") == 1
    assert "collect_list" not in plan(layout.extract_documents(pages))
    got = [(r["at"], r.page_no, r.code, r.chapter, r.description, r.quantity) for r in layout.annexed_items(pages).orderBy("at").collect()]
    assert got == [
        (1, 1, "C01.01", "C01 UNO", "Texto.", 7.0), (2, 1, "C01.02", "C01 UNO", "Texto sin punto y su final.", 4.0), (3, 2, "C01.03", "C01 UNO", "C", 5.0), (4, 3, "C02.01", "C02 DOS", "Texto.", 0.0),
    ]
