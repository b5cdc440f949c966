import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from gneiss.llm import pieces

TEXTS = [
    "", " ", "   leading and   runs  of spaces ", "Hello world, naïve café – 12345", "▁mark ▁▁ and <0x41> <s> </s> <unk>", "line\nbreak\ttab\r\n", "中文字 日本語 한국어 😀👍🏽 ‍",
    "a" * 3000, "x y " * 2000, "\x00\x01 control \x7f", "Straße ﬁ ligature é",
]


@pytest.fixture(scope="module")
def model() -> bytes:
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def test_without_dropout_equals_the_model(model):
    plain = pieces.PieceCoder(model)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvéèßñ,.!-'", k=rng.randint(1, 14))) for _ in range(400)]
    for text in [t for t in TEXTS if "▁" not in t] + [" ".join(rng.choices(words, k=40)) for _ in range(50)]:
        ids = [int.from_bytes(plain.encode(text)[i : i + 4], "little") for i in range(0, len(plain.encode(text)), 4)]
        assert ids == theirs.encode(text), text


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip(model, dropout):
    own = pieces.PieceCoder(model, dropout)
    for lane in (1, 2**63 + 5):
        for text in TEXTS:
            assert own.decode(own.encode(text, lane)) == text


def test_seeds_vary_and_repeat(model):
    text = "segmentations of recurring words differ between lanes and seeds " * 3
    own = pieces.PieceCoder(model, 0.2)
    found = {own.encode(text, lane) for lane in range(12)}
    assert len(found) > 6
    assert {pieces.PieceCoder(model, 0.2).encode(text, lane) for lane in range(12)} == found
    share = sum(len(own.encode(text, lane)) for lane in range(12)) / 12 / len(pieces.PieceCoder(model).encode(text))
    assert 1.05 < share < 2.5


def test_every_occurrence_is_cut_anew(spark, model):
    word = "segmentations"
    df = spark.createDataFrame([(i if i < 150 else None, f"{word} {i}") for i in range(200)], "doc_id long, text string")
    got = pieces.encode_documents(df, dropout=0.2).collect()
    back = pieces.PieceCoder(model)
    ends = {len(back.encode(str(i))) // 4 for i in range(200)}
    assert len({tuple(r.ids[: -max(ends) - 2]) for r in got}) > 10  # two lanes gave few ways to begin
    own = pieces.PieceCoder(model, 0.2)
    assert len(own.encode(" ".join([word] * 40), 5)) != 40 * len(own.encode(word, 5))


def test_each_candidate_is_skipped_by_the_dropout_share(model):
    own = pieces.PieceCoder(model, 0.1)
    gaps = own.gaps(np.full(100_000, 3), np.arange(100_000), 0)
    assert abs((gaps == 0).mean() - 0.1) < 0.005
    assert abs((gaps == 1).mean() - 0.09) < 0.005


def plain_cutting(own: pieces.PieceCoder, word: str, key: int, place: int) -> list[int]:
    """One word's agenda by itself, nothing remembered: a list of candidates, each kept or skipped as it comes up."""
    at = [pieces.SPACE if c == " " else c for c in word]
    get = lambda draw: int(own.gaps(np.array([key]), np.array([place]), draw)[0])
    n, draw, skip = 0, 1, get(0)
    agenda = {i: own.merges.get(a + b) for i, (a, b) in enumerate(zip(at, at[1:]))}
    while found := [(rank, i) for i, rank in agenda.items() if rank is not None]:
        _, i = min(found)
        n += 1
        if n - 1 == skip:
            agenda[i], skip, draw = None, skip + 1 + get(draw), draw + 1
            continue
        at[i : i + 2] = [at[i] + at[i + 1]]
        agenda = {j - (j > i): rank for j, rank in agenda.items() if j not in (i, i + 1, i - 1)} | {
            j: own.merges.get(at[j] + at[j + 1]) for j in (i - 1, i) if 0 <= j < len(at) - 1
        }
    out = []
    for piece in at:
        out += [own.ids[piece]] if piece in own.ids else [own.byte[b] for b in piece.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_equals_a_plain_agenda(model, dropout):
    own = pieces.PieceCoder(model, dropout)
    rng = random.Random(4)
    words = ["segmentation", "international", "extraordinarily", "naïve", "中文字", "a", "xqzjw"]
    for key in range(60):
        text = " ".join(rng.choices(words, k=12))
        ids = np.frombuffer(own.encode(text, key), dtype="<i4").tolist()
        assert ids == [i for place, w in enumerate(text.split(" ")) for i in plain_cutting(own, " " + w, key, place)], text


def test_variety_is_that_of_a_plain_agenda(model):
    own = pieces.PieceCoder(model, 0.1)
    for word in ("segmentation", "international", "extraordinarily"):
        plain = {tuple(plain_cutting(own, " " + word, key, 0)) for key in range(1000)}
        assert {tuple(np.frombuffer(own.encode(word, key), dtype="<i4").tolist()) for key in range(1000)} == plain
        assert len(plain) > 25


def test_documents(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (100, None, 1), (0, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_documents(df)
    assert sorted(r.decoded for r in got.collect()) == sorted(r[1] or "" for r in rows)
    back = pieces.decode_documents(got.select("doc_id", "ids"))
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in rows)
    assert pieces.encode_documents(df.where("false")).collect() == []


def test_a_batch_is_cut_in_parts(model):
    """A worker's memory does not follow what a batch holds, and the parts are cut as each text is alone."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(50)]
    texts = ["", *(" ".join(rng.choices(words, k=400)) for _ in range(1000)), "x y " * 200_000, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    own = pieces.PieceCoder(model, 0.1)
    own.encode_many(texts[:300], list(range(300)))
    small = batch.slice(0, 1001)
    tracemalloc.start()
    for _ in pieces.encode_batch(own, small, 1):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    got = [row for part in pieces.encode_batch(own, batch, 1) for row in zip(*(c.to_pylist() for c in part.columns))]
    assert [g[0] for g in got] == list(range(len(texts))) and [g[3] for g in got] == texts
    alone = pieces.PieceCoder(model, 0.1)
    for i in (0, 1, 500, 1000, 1001, 1002):
        assert got[i][1] == alone.encode_many([texts[i]], [pieces.key_of(i, texts[i], 1)])[0].tolist()
    assert [s.stop - s.start for s in pieces.slices(["a" * 5, "", "b" * 6, "c" * 99, "d"], 10)] == [2, 1, 1, 1]


def test_memory_is_bounded_by_ids_as_well(model, monkeypatch):
    """Long words are never looked up again, but their ids are kept until a worker starts anew."""
    monkeypatch.setattr(pieces, "REMEMBERED_IDS", 10_000)
    own = pieces.PieceCoder(model, 0.1)
    rng = random.Random(9)
    for key in range(40):
        own.encode_many([" ".join("".join(rng.choices("qxzjkw", k=100)) for _ in range(20))], [key])
    assert own.pool.n < 20_000
