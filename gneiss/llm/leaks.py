"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bounded_batches, discard, map_rows, store

MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of an exact copy from which a passage counts as a leak.
THRESHOLD = 0.5
#: One pass over the documents holds items of so many bytes of text in each task, and no more than ``MOST_BYTES``
#: in all that is made of them; more items are taken in blocks.
BLOCK_BYTES, MOST_BYTES = 8 << 20, 256 << 20

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all parts in a row, where each begins and the last ends)."""
    ends = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)).astype(np.int32), ends


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places from each start to before its end, one range after the other."""
    sizes = ends - starts
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


@dataclass
class Items:
    """The test items of one block, as word ids, and the words that seed a search for them.

    An alignment that reaches the threshold matches at least that share of an item's words, but it need not
    hold two of them in a row: longer grams would miss it. So of an item with n words, of which ``need`` must
    match, the n - need + 1 rarest are its seeds; a passage without any of them lacks too many. Rarity (the
    number of items that hold a word) only decides which words these are.
    """

    ids: list[int]
    texts: InitVar[list[str]]
    threshold: float
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self, texts: list[str]) -> None:
        number = self.vocabulary.setdefault
        own = [np.array([number(w, len(self.vocabulary)) for w in words(t)], dtype=np.int32) for t in texts]
        sizes = np.array([len(w) for w in own], dtype=np.int64)
        #: Words of all items one after the other, and where each item's begin.
        self.all_words, self.word_at = _joined(own)
        bags = [np.unique(w, return_counts=True) for w in own]
        #: Of each item, its distinct words and how often it has them.
        self.bag_words, self.bag_at = _joined([b[0] for b in bags])
        self.bag_times, _ = _joined([b[1].astype(np.int32) for b in bags])
        share = self.threshold * sizes
        #: Words of an item that must match, and words of a text that an alignment can span.
        self.need = np.maximum(1, np.ceil(share - 1e-9)).astype(np.int64)
        self.span = np.maximum(1, np.floor((1 + MATCH) * sizes - MATCH * share + 1e-9)).astype(np.int64)
        held = np.bincount(self.bag_words, minlength=len(self.vocabulary))
        seeds = []
        for n, (distinct, times) in enumerate(bags):
            order = np.argsort(held[distinct], kind="stable")
            before = np.cumsum(times[order]) - times[order]
            seeds.append(distinct[order[before <= sizes[n] - self.need[n]]])
        flat, at = _joined(seeds)
        item = np.repeat(np.arange(len(seeds), dtype=np.int32), np.diff(at))
        #: The items that each word is a seed of, and where each word's begin.
        self.seed_items = item[np.argsort(flat, kind="stable")]
        self.seed_at = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(self.vocabulary)))]).astype(np.int64)

    def words(self, n: int) -> np.ndarray:
        return self.all_words[self.word_at[n] : self.word_at[n + 1]]

    def bag(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bag_at[n], self.bag_at[n + 1])
        return self.bag_words[part], self.bag_times[part]

    def n_bytes(self) -> int:
        """Bytes of the arrays, and of the vocabulary at 120 for a word besides its letters."""
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray)) + sum(120 + 4 * len(w) for w in self.vocabulary) + 40 * len(self.ids)

    def read(self, text: str) -> np.ndarray:
        """Word ids of a text, -1 for words of no item."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], dtype=np.int64)

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items of whose words a text has enough, anywhere, to reach the threshold."""
        if not hasattr(self, "_times"):  # all 0 between uses, as is its last place, which stands for unknown words
            self._times = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        present, times = np.unique(ids[ids >= 0], return_counts=True)
        found = np.unique(self.seed_items[_ranges(self.seed_at[present], self.seed_at[present + 1])])
        if not len(found):
            return []
        self._times[present] = times
        at = _ranges(self.bag_at[found], self.bag_at[found + 1])
        held = np.minimum(self._times[self.bag_words[at]], self.bag_times[at])
        self._times[present] = 0
        sizes = self.bag_at[found + 1] - self.bag_at[found]
        return found[np.add.reduceat(held, np.cumsum(sizes) - sizes) >= self.need[found]].tolist()

    def places(self, n: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """(first word, word after the last) of the parts of a text that may hold a passage like item ``n``.

        Two upper bounds on every alignment's score, by the match where it ends: words of the item in a row
        count as matches and others as mismatches whatever their order; and no more words match than the span
        of an alignment holds, each as often as the item has it.
        """
        distinct, times = self.bag(n)
        self._times[distinct] = 1
        at = np.flatnonzero(self._times[ids])
        self._times[distinct] = 0
        each = np.arange(len(at)) * (MATCH - MISMATCH) + at * MISMATCH  # matches and mismatches before it
        ends = each + MATCH - np.minimum.accumulate(each)
        good = ends >= self.threshold * MATCH * len(self.words(n)) - 1e-9
        if not good.any():
            return []
        span = int(self.span[n])
        word = np.searchsorted(distinct, ids[at])
        order = np.argsort(word, kind="stable")
        word, sorted_at = word[order], at[order]
        before = np.full(len(at), -span, dtype=np.int64)  # as many places of the word back as the item has it
        back = np.arange(len(at)) - times[word]
        same = (back >= 0) & (word[back] == word)
        before[same] = sorted_at[back[same]]
        change = np.zeros(len(ids) + span + 1, dtype=np.int64)
        np.add.at(change, np.maximum(sorted_at, before + span), 1)
        np.add.at(change, sorted_at + span, -1)
        held = np.cumsum(change)[at]
        last = at[good & (held >= self.need[n])]
        out: list[tuple[int, int]] = []
        for part in np.split(last, np.flatnonzero(np.diff(last) >= span) + 1):
            if len(part):
                out.append((max(0, int(part[0]) - span + 1), int(part[-1]) + 1))
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, where it ends in ``passage``), one row of the table at a time."""
    ramp = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item.tolist():
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + ramp) - ramp  # gaps along the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def matches(items: Items, text: str) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, word after the last) of the best passage for each leaked item."""
    ids = items.read(text)
    out = []
    for n in items.candidates(ids):
        item = items.words(n)
        best = (0.0, 0, 0)
        for low, high in items.places(n, ids):
            passage = ids[low:high]
            score, end = align(item, passage)
            share = score / (MATCH * len(item))
            if share >= items.threshold and share > best[0]:
                _, back = align(item[::-1], passage[:end][::-1])
                best = (share, low + end - back, low + end)
        if best[0]:
            out.append((items.ids[n], *best))
    return out


def load_items(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, threshold: float) -> Iterator[Items]:
    """The items in blocks of a checked size, one at a time on the driver.

    A block has about ``block_bytes`` of text, by a hash of the item, and is cut in halves for as long as what
    is made of it would have more than ``MOST_BYTES``.
    """
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = size // block_bytes + 1
    for block in range(n_blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).collect()
        todo = [sorted(part, key=lambda r: (r.i is None, r.i or 0, r.t))]
        while todo:
            if part := todo.pop():
                items = Items([r.i for r in part], [r.t for r in part], threshold)
                if len(part) > 1 and items.n_bytes() > MOST_BYTES:
                    todo += [part[len(part) // 2 :], part[: len(part) // 2]]
                else:
                    yield items


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): every document row that holds a passage like an item.

    score is the local alignment's share of an exact copy's (1 means word for word, case and punctuation
    aside), first_word and end_word the passage in words. Whole texts are searched, however many documents
    share a passage; items without words match nothing. Null texts hold nothing, repeated rows are
    reported each, other columns are ignored, and either table may be empty.
    """
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))}
    out = docs.sparkSession.createDataFrame([], schema)
    for items in load_items(benchmark, item_col, item_text, block_bytes, threshold):
        spread = docs.sparkSession.sparkContext.broadcast(items)

        def rows(own: Items, doc_id: int, text: str) -> Iterator[tuple]:
            return ((doc_id, *m) for m in matches(own, text))

        out = out.unionByName(map_rows(docs, columns, rows, schema, lambda spread=spread: spread.value))
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage.

    A benchmark of one block costs one scan and no join. Of several, each is held against what the one before has left, which is
    written in between, so a Python worker never has more than one.
    """
    bounded_batches(docs.sparkSession)
    spark, text, kept, last = docs.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit("")), None, None
    for items in load_items(benchmark, "item_id", "text", block_bytes, threshold):
        if last is not None:
            docs, before = store(docs.where(_clean(last)(text)), "unleaked"), kept
            last.destroy()
            if before is not None:
                discard(before)
            kept = docs
        last = spark.sparkContext.broadcast(items)
    return docs if last is None else docs.where(_clean(last)(text))


def _clean(spread):
    """A condition on texts: whether they hold no passage like one of the broadcast items."""

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not matches(spread.value, t) for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
