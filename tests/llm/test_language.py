import random

from pyspark.sql import functions as F

from gneiss.llm import language

SCHEMA = "doc_id long, text string, lang string, score string"


def corpus(n=160):
    rng = random.Random(4)
    parts = {"aa": ("bra", "kol", "mir", "tan", "zu"), "bb": ("éle", "oux", "ment", "ai", "que"), "cc": ("sch", "ung", "ber", "ver", "ein")}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 300))]
        rows.append((i, " ".join(words), lang, "clash"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    models = language.fit(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in language.identify(df, models).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts(spark):
    models = language.fit(spark.createDataFrame(corpus(40), SCHEMA), F.lit(True))
    rows = [(1, None, None, ""), (2, "", None, ""), (3, "12 34 !!", None, ""), (None, "bra kol mir tan " * 3 + "brakolmir tanzumir kolzubra", None, ""), (5, "ungverbersch " * 40_000, None, ""), (5, "ungverbersch " * 40_000, None, "")]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language.identify(spark.createDataFrame(rows, SCHEMA), models).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (None, "aa", False), (5, "cc", False), (5, "cc", False)], key=str)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, "")], SCHEMA)
    assert language.fit(df, F.lit(True)) == []
    assert [r.lang_pred for r in language.identify(df, []).collect()] == ["und"]
    assert language.identify(df.where("false"), []).collect() == []


def test_narrow_margins_are_rejected(spark):
    both = [("aa", b" one two three four "), ("bb", b" one two three four ")]
    df = spark.createDataFrame([(1, "one two three", None, "")], SCHEMA)
    r = language.identify(df, both).first()
    assert r.rejected and r.lang_pred == "aa" and r.score == 0.5


def test_matches_plain_compression(spark):
    """Each text compressed afresh under each dictionary, without prepared tables."""
    import zstandard

    df = spark.createDataFrame(corpus(60), SCHEMA)
    models = language.fit(df, F.lit(True))
    got = {r.doc_id: r for r in language.identify(df, models).collect()}
    for doc_id, text, *_ in corpus(60):
        sizes = []
        for _, content in models:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data = language.normal(text)
            blocks = [data[i : i + language.BLOCK] for i in range(0, len(data), language.BLOCK)]
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=own, level=language.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress(b)) for b in blocks))
        assert got[doc_id].lang_pred == models[sizes.index(min(sizes))][0]


def test_only_letters_count(spark):
    models = language.fit(spark.createDataFrame(corpus(40), SCHEMA), F.lit(True))
    rows = [(i, t, None, "") for i, t in enumerate(["½²", "Ⅰ Ⅳ", "٣٤", "_", "ª", "中", "ʰ"])]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, SCHEMA), models).collect()}
    assert [got[i] == "und" for i in range(7)] == [True, True, True, True, False, False, False]


def test_an_id_in_very_many_rows_is_learned_once(spark):
    rows = corpus(60) + [(7, f"bra kol {i}", "aa", "") for i in range(3000)]
    models = dict(language.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True)))
    assert set(models) == {"aa", "bb", "cc"} and len(models["aa"]) < 100_000


def test_too_many_languages_are_refused(spark):
    import pytest

    df = spark.createDataFrame([(i, "text", f"l{i}", "") for i in range(language.MAX_LANGUAGES + 1)], SCHEMA)
    with pytest.raises(ValueError):
        language.fit(df, F.lit(True))
