from collections import Counter

import corpus_pipeline as pipeline
from gneiss.llm import leaks, lines, quality, similar
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_similar import plain_groups


def test_every_stage_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, out = docs, {}
    for name, stage in pipeline.STAGES:
        kept = stage(spark, kept, sf)
        out[name] = {r.doc_id: r for r in kept.collect()}
        if name != pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(list(out[name].values()), docs.schema)
    start = {r.doc_id: r.text for r in docs.collect()}

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.learned(docs, labels)).collect()}
    assert set(out["quality_filter"]) == {d for d in start if scores[d] >= 0.3}
    rows = [(d, r.text) for d, r in out["quality_filter"].items()]
    expected = plain_lines(rows)
    import hashlib

    got = {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in out["line_dedup"].items()}
    assert got == {d: v[2] for d, v in expected.items()}
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].values())
    assert set(out["near_dedup"]) == set(plain_groups([(d, r.text) for d, r in out["line_dedup"].items()]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, r in out["near_dedup"].items() if any(" ".join(leaks.words(t)) in " ".join(leaks.words(r.text)) for _, t in items)}
    assert not leaked & set(out["decontaminate"]) and len(out["near_dedup"]) - len(leaked) == len(out["decontaminate"])
    assert {d: r.decoded_sha256 for d, r in out["encode"].items()} == {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in out["decontaminate"].items()}


def test_run_gives_the_last_stage(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_pieces", "decoded_sha256"]
    assert max(Counter(r.doc_id for r in out.select("doc_id").collect()).values()) == 1


def test_stages_call_the_operators():
    assert [name for name, _ in pipeline.STAGES] == ["quality_filter", "line_dedup", "near_dedup", "decontaminate", "encode"]
    assert all((similar, lines))


def odd_documents(spark):
    """Nulls in every column, empty, repeated and very long texts, and columns with the operators' own names."""
    extra = "n_lines string, keep string, _kept string, component_id string, score string, ids string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    clash = ("x",) * 6
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "A line that three of the documents share\nown text {0} of it here", long, "é 中文 😀\x00 {0}", "same text in two rows of one id"]
    rows = [(i, (t or "").format(i) if t is not None else None, None if i % 3 else "en", None, None, *clash) for i, t in enumerate(texts * 4)]
    rows += [(None, "a text without an id", "en", "web", 5, *clash), (None, None, None, None, None, *clash), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, schema)


def test_stages_take_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    labels = [(i, i % 2, 0) for i in range(16)] + [(None, 1, None), (3, None, 0), (3, 1, 1), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "zz yy xx ww vv uu"), (None, "one"), (2, None), (3, ""), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        for given in (docs, docs.where("false"), docs.where("doc_id IS NULL"), docs.limit(1)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            assert len(rows) <= given.count(), name
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == pipeline.COLUMNS, name
            if given is docs and name in ("line_dedup", "encode"):
                assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()), name
    kept = [r.doc_id for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert kept.count(None) == 2  # rows without an id stay
    assert {0, 3, 4, 5, 6, 7} <= set(kept) and not {8, 11, 13, 15} & set(kept)
    left = {r.doc_id for r in pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert 3 not in left and {0, 1, 4, 5} <= left  # the item "one" is a whole text


def test_run_on_empty_tables(spark, tmp_path):
    odd_documents(spark).select(pipeline.COLUMNS).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
