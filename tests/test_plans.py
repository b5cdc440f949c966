"""Composite operators on the small examples that define them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gneiss.operators import matching, ordered
from gneiss.plans import dag, layout, retrieval
from gneiss.sources import sinks

ITEM = "doc_id long, seq long, code string, description string"


def test_cascade_uses_each_side_once(spark):
    golden = [(1, 0, "4.1.9", "Solado de gres porcelánico"), (1, 1, "2.1", "Pintura plástica lisa en paredes"), (1, 2, "9.9", "Nada parecido"), (1, 3, "2.1", "repetida")]
    found = [(1, 0, "4-1-9", "otra"), (1, 1, "x", "Pintura plastica lisa en paredes"), (1, 2, "2.1", "igual código"), (1, 3, "y", "zzzz")]
    m = matching.cascade_match(spark.createDataFrame(golden, ITEM), spark.createDataFrame(found, ITEM), "doc_id")
    assert {(r.golden_seq, r.found_seq, r.level) for r in m.collect()} == {(1, 2, "exact_code"), (0, 0, "normalized_code")}
    again = matching.full_outer_match(spark.createDataFrame(golden[1:2], ITEM), spark.createDataFrame(found[1:2], ITEM), "doc_id")
    assert [(r.golden_seq, r.found_seq, r.level) for r in again.collect()] == [(1, 1, "fuzzy_description")]


def test_full_match_pads_codes_and_takes_the_last_of_a_code(spark):
    golden = [(1, 0, "C4.2", "uno"), (1, 1, "04.02", "dos"), (1, 2, None, ""), (1, 3, "9", "Solado de gres"), (1, 4, "8", "Solado de gres"), (1, 5, "7", None), (2, 0, "1.1", "x")]
    found = [(1, 0, "4.2", "antes"), (1, 1, "C04.2", "uno"), (1, 2, "z", "Solado de  gres"), (1, 3, "y", None), (1, 4, "x", "nada"), (1, 5, "w", "solado de gres")]
    m = matching.full_outer_match(spark.createDataFrame(golden, ITEM), spark.createDataFrame(found, ITEM), "doc_id")
    rows = {(r.doc_id, r.golden_seq, r.found_seq, r.level) for r in m.collect()}
    assert rows == {
        (1, 0, 1, "exact_code"), (1, 1, 1, "exact_code"), (1, 2, 3, "fuzzy_description"), (1, 3, 5, "fuzzy_description"), (1, 4, 2, "fuzzy_description"),
        (1, 5, None, "missing"), (2, 0, None, "missing"), (1, None, 0, "extra"), (1, None, 4, "extra"),
    }


def test_similar_pairs_lose_none(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(7)
    words = ["solado", "gres", "porcelánico", "ALICATADO", "baño", "pintura", "plástica", "muro", "de", "x", "ñandú", "🙂", "10x10"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
    golden, found = ([(rng.randint(1, 2), i, "", text()) for i in range(60)] + [(1, 99, "", None), (1, 98, "", "")] for _ in range(2))
    for t in (0.4, 0.55, 0.75, 1.0):
        got = matching.similar_pairs(spark.createDataFrame(golden, ITEM), spark.createDataFrame(found, ITEM), "doc_id", t).collect()
        ratio = lambda a, b: SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()
        want = {(d, i, j): ratio(a, b) for d, i, _, a in golden for e, j, _, b in found if d == e and a and b and ratio(a, b) >= t}
        assert {(r.doc_id, r.golden_seq, r.found_seq): r.ratio for r in got} == want and len(got) == len(want)


def test_metrics(spark):
    g = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 0.0), (4, 5.0)], "id long, gp double")
    m = spark.createDataFrame([(100.0, 120.0), (100.0, 80.0), (0.0, 9.0)], "gp double, fp double")
    r = matching.match_metrics(m, g, "gp", "fp").first()
    assert (r.recall, r.price_delta_p50, r.price_delta_p95) == (0.75, pytest.approx(0.2), pytest.approx(0.2))
    empty = matching.match_metrics(m.where("false"), g.where("false"), "gp", "fp").first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_canonical_chapters(spark):
    names = ["C02 ALBAÑILERIA", "C01 TRABAJOS PREVIOS", "C02 TABIQUES Y PARTICIONES", "C03", "C03 AISLAMIENTOS", "C03", ""]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "doc_id long, seq int, chapter string")
    got = [r.chapter for r in ordered.canonical_chapters(df, ["doc_id"], "seq").orderBy("seq").collect()]
    assert got == ["C02 ALBAÑILERIA", "C01 TRABAJOS PREVIOS", "C02 ALBAÑILERIA", "C03 AISLAMIENTOS", "C03 AISLAMIENTOS", "C03 AISLAMIENTOS", ""]


def test_forward_fill_chapter(spark):
    names = [None, "C01 OBRA", "CONTINUACION_ANTERIOR", "NOT FOUND", "C01 OBRA NUEVA", "C01", "C02 YESO"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "doc_id long, seq int, chapter string")
    got = [r.chapter for r in ordered.forward_fill_chapter(df, ["doc_id"], "seq").orderBy("seq").collect()]
    assert got == ["", "C01 OBRA", "C01 OBRA", "C01 OBRA", "C01 OBRA NUEVA", "C01 OBRA NUEVA", "C02 YESO"]


@pytest.mark.parametrize("blocks,expected", [([[70.0, 2.8], [72.8, 1.0]], [72.8, 1.0]), ([[26.0], [26.0, 6.0, 20.0]], [26.0, 26.0]), ([[1.0]], [1.0])])
def test_carry_over(spark, blocks, expected):
    rows = [(1, b, i, q) for b, qs in enumerate(blocks) for i, q in enumerate(qs)]
    df = spark.createDataFrame(rows, "doc_id long, block int, at int, q double")
    assert [r.q for r in ordered.drop_carry_over(df, ["doc_id"], "block", "at", "q").orderBy("block").collect()] == pytest.approx(expected)


def test_clamped_score_counts_an_event_once(spark):
    df = spark.createDataFrame([(1, 1, "a", 80.0), (1, 2, "b", 60.0), (1, 3, "b", 60.0), (1, 4, "c", -30.0)], "id long, at int, ev string, d double")
    assert ordered.clamped_score(df, ["id"], "at", "ev", "d").first().score == 70.0


def test_grouped_runs(spark):
    rows = [(1, i, e, c) for i, (e, c) in enumerate([(True, "a")] * 7 + [(False, "a")] * 3 + [(True, "b"), (True, "a")])]
    df = spark.createDataFrame(rows, "d long, seq int, easy boolean, chapter string")
    assert [r.group_id for r in ordered.grouped_runs(df, ["d"], "seq", "easy", "chapter").orderBy("seq").collect()] == [0] * 5 + [5, 5, 7, 8, 9, 10, 11]


def test_topological_levels_of_chains_and_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in ("B", "A", "C")], "node string")
    cycle = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "gone")], "node string, needs string")
    assert {r.node: r.level for r in dag.topological_levels(nodes, cycle).collect()} == {"C": 0, "A": None, "B": None}
    behind = spark.createDataFrame([("A", "A"), ("B", "A"), ("B", "C")], "node string, needs string")
    assert {r.node: r.level for r in dag.topological_levels(nodes, behind).collect()} == {"C": 0, "A": None, "B": None}
    assert {r.level for r in dag.topological_levels(nodes, cycle.where("false")).collect()} == {0}
    diamond = spark.createDataFrame([("B", "A"), ("C", "A"), ("C", "B"), ("B", "A")], "node string, needs string")
    assert {r.node: r.level for r in dag.topological_levels(nodes, diamond).collect()} == {"A": 0, "B": 1, "C": 2}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = dag.stored
    monkeypatch.setattr(dag, "stored", lambda df, label: rounds.append(label) or real(df, label))
    n = 10_000
    levels = dag.topological_levels(spark.range(n).withColumnRenamed("id", "node"), spark.range(1, n).selectExpr("id AS node", "id - 1 AS needs"))
    assert levels.where("level <> node").isEmpty() and levels.count() == n
    assert len(rounds) < 20


def test_planned_orders(spark):
    graph = {"DEM": (), "TIERRAS": ("DEM",), "HORM": ("TIERRAS",), "B": (), "LATE": ("ZZ",), "ZZ": (), "SEG": ("DEM",), "X1": ("X2",), "X2": ("X1",)}
    given = {
        1: ["HORM", "DEM", "TIERRAS"], 2: ["LATE", "?1", "SEG", "B", "ZZ", "?0", "B"], 3: ["HORM", "ZZ"], 4: ["X1", "SEG", "X2", "DEM"], 5: ["LATE", "ZZ", "B"],
    }
    rows = [(k, i, c) for k, cs in given.items() for i, c in enumerate(cs)]
    out = dag.planned_orders(spark.createDataFrame(rows, "doc long, seq int, chapter string"), graph, ("SEG",), "doc").orderBy("doc", "position").collect()
    got = {k: [r.chapter for r in out if r.doc == k] for k in given}
    assert got == {
        1: ["DEM", "TIERRAS", "HORM"], 2: ["ZZ", "LATE", "B", "SEG", "?1", "?0"], 3: ["HORM", "ZZ"], 4: ["DEM", "X1", "X2", "SEG"], 5: ["ZZ", "LATE", "B"],
    }


def test_index_recall_and_all_lists(spark):
    import numpy as np

    from gneiss.operators.index import VectorIndex
    from gneiss.operators.joins import nearest

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 16)) * 0.4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(2000, None), (2001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).cache()
    q = df.where("id % 50 = 0").select(F.col("id").alias("q"), "embedding")
    index = VectorIndex.fit(df, lists=20, sample_rows=500)
    indexed = index.indexed(df).cache()
    assert indexed.count() == 2002 and indexed.where("_list = -1").count() == 2
    exact = {(r.q, r.id) for r in nearest(q, df, 10, "q", "id").collect()}
    some = {(r.q, r.id) for r in index.nearest(q, indexed, 10, "q", "id", probes=5).collect()}
    assert len(some) == len(exact) and len(some & exact) >= 0.9 * len(exact)
    assert {(r.q, r.id) for r in index.nearest(q, indexed, 10, "q", "id", probes=20).collect()} == exact


def test_index_query_finds_nine_of_ten(spark, sf):
    from gneiss import catalog
    from gneiss.operators.joins import nearest

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.q, r.vec_id) for r in nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"), e, 10, "q", "vec_id").collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.queries()["join_knn_index"](spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_products_are_bounded(spark, monkeypatch):
    import numpy as np

    from gneiss.operators import joins

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 4)))], "id long, embedding array<float>")
    q = df.select(F.col("id").alias("q"), "embedding")
    whole = sorted(tuple(r) for r in joins.nearest(q, df, 3, "q", "id").collect())
    monkeypatch.setattr(joins, "PRODUCT_BYTES", 8 * 1000)
    assert [r[:2] for r in sorted(tuple(r) for r in joins.nearest(q, df, 3, "q", "id").collect())] == [r[:2] for r in whole]


def test_layout_classes_and_items(spark):
    inline = "\n".join(["C01.01 Partida m2 DEMOLICIÓN DE TABIQUE", "Demolición por medios manuales.", "72,80", "C01.02 Partida Ud PUERTA", "72,80", "1,00 Ud", "C01.03 Partida ml RODAPIÉ", "x" * 150])
    front, back = "\n".join(f"{i}.{j} Ud TÍTULO" for i in (1, 2) for j in range(3)) + "x" * 40, "\n".join(["12,50 m2"] * 4)
    pages = [(1, 1, inline)] + [(2, p, front) for p in range(1, 4)] + [(2, p, "texto") for p in range(4, 7)] + [(2, p, back) for p in range(7, 10)] + [(3, 1, None), (3, 2, "")] + [(4, 1, "lorem ipsum " * 50)]
    df = spark.createDataFrame(pages, "doc_id long, page_no int, text string")
    assert {r.doc_id: r.layout for r in layout.classify(df).collect()} == {1: "INLINE_WITH_TITLES", 2: "TWO_PHASE_ANNEXED", 3: "UNKNOWN", 4: "UNKNOWN"}
    items = {r.code: r for r in layout.extract_items(df.where("doc_id = 1")).collect()}
    assert (items["C01.01"].quantity, items["C01.01"].description, items["C01.02"].quantity) == (72.8, "Demolición por medios manuales.", 1.0)


def test_retrieval(spark):
    same = "Alicatado de gres porcelánico en baño"
    lines = spark.createDataFrame([(1, "02.04", "C02 Alicatados", same, ["tiles"])], "line_id long, code string, chapter string, description string, topics array<string>")
    now = datetime(2026, 1, 1)
    frag = lambda i, desc=same, days=10, status="golden", base=False, tags=("chapter:C02 Alicatados", "tiles"): (i, status, list(tags), desc, now - timedelta(days=days), base)
    schema = "fragment_id long, status string, tags array<string>, description string, at timestamp, is_baseline boolean"
    run = lambda *rows, **k: [r.fragment_id for r in retrieval.retrieve_fragments(lines, spark.createDataFrame(rows, schema), "2026-01-01", **k).orderBy("rank").collect()]
    assert run(frag(1, base=True)) == [1]
    assert run(frag(1)) == []
    assert run(frag(1), frag(2, "Alicatado de gres en baño"), frag(3, days=999), frag(4, status="draft"), frag(5, tags=("chapter:c02", "wood")), frag(6, " ")) == [1, 2]
    tags = (["cross_chapter:true"], ["chapter_code:2", "tiles"], ["chapter_code:02", "reason:x", "Tiles"], ["Chapter:ALICATADOS"], ["chapter_code:3"], ["tiles"], None)
    assert run(*(frag(i, tags=t or ()) for i, t in enumerate(tags))) == [0, 1, 2, 3]
    assert len(run(*(frag(i) for i in range(9)))) == 9 and len(run(*(frag(i) for i in range(9)), top=5)) == 5


def test_fragments_are_those_of_all_pairs(spark):
    """The joins on codes, grams of names and topics against rules over every pair of line and fragment."""
    import random

    rng = random.Random(6)
    kinds = ["tiles", "Tiles", "paint", "reason:x", "scope:y"]
    texts = ["Alicatado de gres porcelánico en baño", "Alicatado de gres en baño", "Pintura plástica lisa", "Pintura plástica en paredes lisas"]
    names = ["C02 Alicatados", "Pinturas y acabados", "ÑU", "", None]
    tag = lambda: rng.choice(["cross_chapter:true", f"chapter_code:{rng.choice(['2', '02', '7'])}", f"chapter:{rng.choice(['alicatados', 'PINT', 'ñu', 'a', '', 'c02 alicatados y más'])}", rng.choice(kinds), rng.choice(kinds)])
    now = datetime(2026, 1, 1)
    lines = [(i, rng.choice(["02.04", "7.1", "x", None]), rng.choice(names), rng.choice(texts), rng.choice([["tiles"], ["paint", "wood"], [], None])) for i in range(40)]
    fragments = [(i, "golden", [tag() for _ in range(rng.randint(0, 3))], rng.choice(texts), now - timedelta(days=i % 30), i % 5 == 0) for i in range(60)]
    left = spark.createDataFrame(lines, "line_id long, code string, chapter string, description string, topics array<string>")
    right = spark.createDataFrame(fragments, "fragment_id long, status string, tags array<string>, description string, at timestamp, is_baseline boolean")
    both = left.select("line_id", "description").crossJoin(right.select("fragment_id", F.col("description").alias("other")))
    alike = {(r.line_id, r.fragment_id): r.s for r in both.select("line_id", "fragment_id", matching.hybrid_similarity(F.col("description"), F.col("other")).alias("s")).collect()}

    def applies(code, chapter, tags):
        number = (code.split(".")[0].lstrip("0") or "0").zfill(2) if code and "." in code else None
        of = lambda name: [t[len(name) + 1 :].strip() for t in (x.lower() for x in tags) if t.startswith(name + ":") and t[len(name) + 1 :].strip()]
        return "cross_chapter:true" in tags or number in [c.lstrip("0").zfill(2) for c in of("chapter_code")] or any(c in (chapter or "").lower() for c in of("chapter"))

    want = {}
    for i, code, chapter, _, topics in lines:
        own = []
        for f, _, tags, _, at, base in fragments:
            about = {t.lower() for t in tags if not t.lower().startswith(retrieval.META_TAGS) and not t.lower().startswith("chapter_code:")}
            about |= {t.lower() for t in tags if t.lower().startswith("chapter_code:")}  # no meta tag
            if applies(code, chapter, tags) and (not topics or not about or set(topics) & about) and alike[i, f] >= 0.45:
                own.append((-alike[i, f], -at.timestamp(), f, base))
        if len(own) >= 2 or any(b for *_, b in own):
            want |= {(i, f): n for n, (_, _, f, _) in enumerate(sorted(own), 1)}
    got = retrieval.retrieve_fragments(left, right, "2026-01-01")
    assert {(r.line_id, r.fragment_id): r["rank"] for r in got.collect()} == want and len(want) > 100
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_table_head_in_any_case(spark):
    text = "CÓDIGO UD RESUMEN\n" + "\n".join(f"1.{i} Ud TÍTULO {i}" for i in range(4)) + "\n" + "x" * 200
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, page_no int, text string")
    assert layout.classify(df).first().confidence == 0.85


def test_work_lines_and_pages(spark):
    lines = [("  SUMINISTRO y colocación de puerta interior",), ("Puerta interior de suministro y colocación",), ("Picado corto",), (None,)]
    assert [r[0] for r in spark.createDataFrame(lines, "t string").select(layout.work_line(F.col("t"))).collect()] == [True, False, False, None]
    docs = spark.createDataFrame([(1, "a\nb\fc\nd\ne"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in layout.text_pages(docs, lines=2).collect()) == [(1, 1, "a\nb"), (1, 2, "c\nd"), (1, 3, "e"), (2, 1, "")]


def test_file_names(spark):
    from gneiss.functions import files

    names = ["20240105_PPTO Hotel Marte-Reforma V6_solo local.PDF", "2025-03-01 reforma hotel marte.xlsx", "20241345_Casa rev 02.bc3", "notas revisada.pdf", "plano.dwg", "marte reforma hotel v2.bc3"]
    rows = files.plan(files.parsed(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"), "name"), "i")
    got = {r.i: (r.slug, str(r.date), r.version, r.category) for r in rows.collect()}
    assert got == {
        0: ("hotel_marte_reforma", "2024-01-05", 6, files.DRAFTS),
        1: ("hotel_marte_reforma", "2025-03-01", 0, files.GOLDEN),
        2: ("casa", "None", 2, files.DRAFTS),
        3: ("notas", "None", 1, files.DRAFTS),
        4: ("_", "None", 0, files.RAW),
        5: ("hotel_marte_reforma", "None", 2, files.DRAFTS),
    }


def test_positions_and_percentiles(spark):
    from gneiss.operators.aggregate import percentiles, positions

    df = spark.createDataFrame([(float(i * 7 % 101),) for i in range(101)] + [(None,)], "v double").repartition(5)
    assert all(r.v == r.position for r in positions(df.where("v IS NOT NULL"), "v").collect())
    assert tuple(percentiles(df, "v", a=("middle", 0.125), b=("lower", 0.129)).first()) == (12.5, 12.0)
    assert tuple(percentiles(df.where("false"), "v", a=("middle", 0.5)).first()) == (None,)


def test_nearest_matches_all_pairs(spark):
    import numpy as np

    from gneiss.operators.joins import nearest

    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[5], vectors[9], vectors[11] = 0, vectors[8], vectors[8]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(300, None)], "id long, embedding array<float>").repartition(4)
    unit = np.vstack([vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), np.zeros(8)])
    q = df.where("id % 50 = 0").select(F.col("id").alias("q"), "embedding")
    for block in (64 << 20, 130):
        got = {(r.q, r["rank"]): r.id for r in nearest(q, df, 7, "q", "id", block_bytes=block).collect()}
        for i in range(0, 301, 50):
            score = np.round(unit @ unit[i], 9)
            best = sorted(range(301), key=lambda j: (-score[j], j))[:7]
            assert [round(float(score[got[i, n]]), 6) for n in range(1, 8)] == [round(float(score[j]), 6) for j in best]


def cascade_plain(golden, found, threshold=0.75):
    """Rows (seq, code, description) of one block, golden ones in order, each found one used once."""
    import re
    from difflib import SequenceMatcher

    clean, used, out = (lambda c: re.sub(r"[^\w]", "", c).lower()), set(), {}
    for level, key in (("exact_code", lambda c: c), ("normalized_code", clean)):
        for g, code, _ in golden:
            if g not in out and key(code):
                hit = next((p for p, c, _ in found if p not in used and key(c) == key(code)), None)
                if hit is not None:
                    out[g] = (hit, level)
                    used.add(hit)
    for g, _, text in golden:
        if g not in out and text:
            best = max(((SequenceMatcher(None, text.lower(), d.lower()).ratio(), -p) for p, _, d in found if p not in used), default=(0, 0))
            if best[0] >= threshold:
                out[g] = (-best[1], "fuzzy_description")
                used.add(-best[1])
    return out


def full_plain(golden, found, threshold=0.55):
    """As above, by padded codes of which the last found row counts, however often."""
    import re
    from difflib import SequenceMatcher

    def padded(code):
        m = re.match(r"^C?(\d+)\.(\d+)(?:\.(\d+))?$", code.upper())
        return ".".join(x.zfill(2) for x in m.groups() if x) if m else code.upper()

    last = {padded(c): p for p, c, _ in found}
    out = {g: (last[padded(c)], "exact_code") for g, c, _ in golden if padded(c) in last}
    used = {p for p, _ in out.values()}
    for g, _, text in golden:
        if g not in out:
            best = max(((SequenceMatcher(None, text.lower(), d.lower()).ratio(), -p) for p, _, d in found if p not in used), default=(0, 0))
            if best[0] >= threshold:
                out[g] = (-best[1], "fuzzy_description")
                used.add(-best[1])
    return out


def test_cascade_queries_match_plain_version(spark, sf):
    from collections import defaultdict

    from gneiss import catalog

    from gneiss.sources.tables import Tables
    from gneiss.workloads.composite import _sides

    blocks = defaultdict(lambda: ([], []))
    for n, side in enumerate(_sides(Tables(spark, sf))):
        for r in side.orderBy("seq").collect():
            blocks[r.block][n].append((r.seq, r.code, r.description or ""))
    for name, version in (("join_cascade_match", cascade_plain), ("join_cascade_full", full_plain)):
        got = defaultdict(dict)
        for r in catalog.queries()[name](spark, sf).collect():
            if r.golden_seq is not None and r.found_seq is not None:
                got[r.block][r.golden_seq] = (r.found_seq, r.level)
        assert dict(got) == {b: m for b, (g, f) in blocks.items() if (m := version(g, f))}
        assert {level for m in got.values() for _, level in m.values()} >= ({"fuzzy_description"} | ({"exact_code"} if name.endswith("full") else set()))
    report = catalog.queries()["pipe_eval_report"](spark, sf).first()
    matched = {b: cascade_plain(g, f) for b, (g, f) in blocks.items()}
    n, levels = sum(len(g) for g, _ in blocks.values()), [x for m in matched.values() for _, x in m.values()]
    assert (report.golden_count, report.matches_count, report.recall) == (n, len(levels), round(len(levels) / n, 3))
    assert report.precision_1to1 == round(levels.count("exact_code") / len(levels), 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b;c", 2.5)], "id long, t string, v double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("v IS NULL").count() == 1
    sinks.replace_children(df, str(tmp_path / "p"), "id")
    sinks.replace_children(df.where("id = 2").withColumn("t", F.lit("new")), str(tmp_path / "p"), "id")
    assert {(r.id, r.t) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a"), (2, "new")}
    sinks.delete_where(spark, str(tmp_path / "p"), str(tmp_path / "d"), F.col("v") > 1)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "d")).collect()] == [1]
    assert sinks.markdown_report(df, "T").splitlines()[2:4] == ["| id | t | v |", "| --- | --- | --- |"]
