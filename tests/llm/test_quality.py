import random

import numpy as np
from pyspark.sql import functions as F

from gneiss.llm import quality

SCHEMA = "doc_id long, text string, score string"


def corpus(n=600):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(5, 120))
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            body = [w.upper() + "!!" for w in body] if kind == 0 else [w for w in body for _ in range(6)] if kind == 1 else [w + "$$$" for w in body]
        docs.append((i, " ".join(body), "clash"))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d, y, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    held = [(i, q) for i, q in labels if i % 5 == 0]
    assert sum(got[i].predicted == q for i, q in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    loss = -np.mean([np.log(got[i].score if q else 1 - got[i].score) for i, q in held])
    assert loss < 0.25
    kept = quality.drop_low_quality(d, y)
    assert kept.columns == d.columns and 0.7 * len(docs) < kept.count() < 0.9 * len(docs)


def test_odd_texts_and_labels(spark):
    docs, labels = corpus(120)
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels + [(3, None), (None, 1), (9999, 0), (4, 1)], "doc_id long, quality int")
    model = quality.fit(d, y, F.lit(True))
    odd = spark.createDataFrame([(None, "abc", ""), (1, None, ""), (1, "", ""), (2, "word " * 100_000, ""), (2, "word " * 100_000, "")], SCHEMA)
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.score(odd.where("false"), model).collect() == []


def test_without_labels(spark):
    docs, _ = corpus(20)
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(d, quality.fit(d, none, F.lit(True))).collect()} == {0.5}
    empty = quality.fit(d.where("false"), none, F.lit(True))
    assert not empty.vectors.any()


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs, _ = corpus(60)
    d = spark.createDataFrame(docs, SCHEMA)
    assert np.array_equal(quality.word_vectors(d.repartition(1)), quality.word_vectors(d.repartition(7)))


def test_word_vectors_and_scores_match_plain_loops(spark):
    docs, labels = corpus(60)
    docs.append((60, "Antidisestablishmentarianism antidisestablishmentarianist " * 3, ""))
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    places, signs = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.WIDTH))
    for _, text, _ in docs:
        ids = quality.tokens(text).tolist()
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    total[a, places[ids[j]]] += signs[ids[j]]
    plain = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(d), plain, atol=1e-6)
    model = quality.fit(d, y, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    net = model.network
    for i, text, _ in docs:
        ids = quality.tokens(text).tolist()
        x = [*np.mean([model.vectors[t].astype(float) for t in ids], axis=0), np.log1p(len(ids)) / 10, np.log1p(len(set(ids))) / 10]
        hidden = [max(0.0, float(np.dot((np.array(x) - net.mean) / net.scale, net.w1[:, k]) + net.b1[k])) for k in range(quality.HIDDEN)]
        logit = (float(np.dot(hidden, net.w2)) + net.b2) / net.temperature
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_long_words_count_whole():
    assert quality.bucket("x" * 30 + "a") != quality.bucket("x" * 30 + "b")


def test_an_id_in_very_many_rows_is_learned_once(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs + [(3, f"again {i}", "") for i in range(2000)], SCHEMA)
    model = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    assert model.network is not None
