"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bounded_batches, map_texts, remainder

#: Words share so many vectors, by hash: the table of vectors is bounded whatever the vocabulary.
BUCKETS, WIDTH, NONZERO, WINDOW = 1 << 14, 64, 4, 2
#: The vectors of repeated words.
AGAIN, AGAIN_NEAR = BUCKETS - 1, BUCKETS - 2
#: The network is fitted on at most so many labelled documents, chosen by a hash of their id.
SAMPLE_DOCS = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|\n|_+")
#: Longer words are hashed each time, so that what is remembered stays small.
LONGEST_SEEN = 40
_SEEN: dict[str, int] = {}


def bucket(token: str) -> int:
    """A word's vector: by its letters and by how they are cased, so that shouting is another word."""
    at = _SEEN.get(token)
    if at is None:
        if len(_SEEN) > 400_000:
            _SEEN.clear()
        shape = "U" if len(token) > 1 and token.isupper() else ""
        at = zlib.crc32((shape + token).encode("utf-8", "replace")) % (BUCKETS - 2)
        if len(token) <= LONGEST_SEEN:
            _SEEN[token] = at
    return at


def tokens(text: str) -> np.ndarray:
    """A text as words; a word that repeats the last one, or the one before it, is a word of its own kind."""
    words = _TOKEN.findall(text)
    found = list(map(_SEEN.get, words))
    if None in found:
        found = list(map(bucket, words))
    ids = np.array(found, dtype=np.int64)
    out = ids.copy()
    out[2:][ids[2:] == ids[:-2]] = AGAIN_NEAR
    out[1:][ids[1:] == ids[:-1]] = AGAIN
    return out


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's sparse random index vector: ``NONZERO`` places and their signs."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), size=(BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, WIDTH) word vectors from the neighbours of every word of every document.

    Each task adds up the index vectors of the words within ``WINDOW`` places and returns one row for each
    bucket it met; the rows are summed by bucket. Sums are whole numbers, so the order of tasks does not
    matter. The result has a fixed size (BUCKETS x WIDTH numbers) and comes to the driver.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH, dtype=np.int64)
        seen = np.zeros(BUCKETS, dtype=np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            me, other = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            at = (me[:, None] * WIDTH + places[other]).ravel()
            total[:] += np.bincount(at, weights=signs[other].ravel(), minlength=BUCKETS * WIDTH).astype(np.int64)

        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = tokens(text)
                seen += np.bincount(ids, minlength=BUCKETS)
                for gap in range(1, WINDOW + 1):
                    a, b = ids[:-gap], ids[gap:]
                    waiting += [(a, b), (b, a)]
                size += len(ids)
                if size >= 100_000:
                    add()
                    size = 0
        if waiting:
            add()
        met = np.flatnonzero(seen)
        vectors = total.reshape(BUCKETS, WIDTH)[met]
        for i in range(0, len(met), 4096):
            flat = vectors[i : i + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(met[i : i + 4096]), pa.array(seen[met[i : i + 4096]]), pa.array(list(flat), type=pa.list_(pa.int64()))], names=["bucket", "n", "v"]
            )

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "bucket long, n long, v array<bigint>")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)))
    found = sums.toPandas()
    out = np.zeros((BUCKETS, WIDTH))
    out[found["bucket"].to_numpy(dtype=np.int64)] = found[[f"v{i}" for i in range(WIDTH)]].to_numpy(dtype=np.float64)
    return np.ascontiguousarray(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), dtype=np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean of its words' vectors and its length; none for an empty text."""
    ids = tokens(text)
    out = np.zeros(vectors.shape[1] + 2, dtype=np.float64)
    if len(ids):
        counts = np.bincount(ids, minlength=0)
        met = np.flatnonzero(counts)
        out[:-2] = (counts[met] / len(ids)) @ vectors[met]
        out[-2] = np.log1p(len(ids)) / 10
        out[-1] = np.log1p(len(met)) / 10
    return out


@dataclass
class Network:
    """Two layers of weights and the temperature that calibrates their logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Fit on four fifths of the rows with Adam; the temperature is fitted on the fifth left out."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, rows = order[:cut], order[cut:] if len(x) > 5 else order
    mean, scale = x[rows].mean(0), x[rows].std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), 0.0)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            hidden = np.maximum(z[part] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30)))
            g = (p - y[part]) / len(part)
            back = np.outer(g, params[2]) * (hidden > 0)
            grads = [z[part].T @ back + DECAY * params[0], back.sum(0), hidden.T @ g + DECAY * params[2], np.array([g.sum()])]
            step += 1
            for k, (param, grad, (m, v)) in enumerate(zip(params, grads, moments)):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                params[k] = param - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                moments[k] = (m, v)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t)))

    net.temperature = min(np.geomspace(0.25, 16, 97).tolist(), key=loss)
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    prior: float = 0.5

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.prior)
        return self.network.probability(np.stack([pooled(t or "", self.vectors) for t in texts]))


def fit(
    docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS
) -> Model:
    """Word vectors from all documents; the network from a bounded sample of labelled rows that ``learn`` allows.

    A document with several labels counts with its largest, rows that share an id count once (with the least
    features); null labels are ignored. Without rows of both labels the score is the share of label 1 (a half
    without any).
    """
    vectors = word_vectors(docs, text_col)
    truth = labels.where(F.col(label_col).isNotNull() & learn).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = truth.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    spread = docs.sparkSession.sparkContext.broadcast(vectors)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    sample = texts.join(F.broadcast(chosen), "id")
    rows = map_texts(
        sample,
        {"id": F.col("id"), "y": F.col("y"), "t": F.col("t")},
        lambda v, i, y, t: (i, y, pooled(t, v).tolist()),
        "id long, y int, x array<double>",
        lambda: spread.value,
    )
    rows = rows.groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r.id, r.x))
    y = np.array([r.y for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    return Model(vectors, train(np.array([r.x for r in rows]), y), float(y.mean()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row, from its whole text alone.

    Null and empty texts get the score of a document without words; repeated rows and rows whose id is null
    are scored like any other; other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = spread.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of op3: labels only of rows whose fold is not 0."""
    return fit(docs, labels, remainder("doc_id", 5) != 0)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    model = learned(docs, labels)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(spread.value.scores(texts.tolist()) >= threshold)

    bounded_batches(docs.sparkSession)
    return docs.where(F.pandas_udf(good, "boolean")(F.col("text").cast("string")))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of them is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, learned(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
