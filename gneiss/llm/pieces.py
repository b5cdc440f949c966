"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Cuttings that a worker remembers, and ids in them; beyond, it starts anew.
REMEMBERED, REMEMBERED_IDS = 250_000, 2_000_000
#: Characters of the texts that are cut at once, which bounds what a worker holds besides; a longer text is cut alone.
AT_ONCE = 1 << 19
#: Longer words have an agenda of their own each time.
SHORT = 32
#: More candidates than a short word can have: each merge brings two new ones at most.
MOST = 128
#: Stands for the mark in a text, which no merge may touch.
RAW = "￾▁"
#: The rank of a pair that no piece is made of.
NO_RANK = 1 << 30

_WORD = re.compile(" +[^ ]*")
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def skipped(key: int, piece: int, left: int, threshold: int) -> bool:
    """Whether the merge to ``piece`` at ``left`` is left out: a hash below the threshold, of 64 bits."""
    x = (key ^ (piece * 0x9E3779B97F4A7C15 + left * 0xC2B2AE3D27D4EB4F)) * 0x94D049BB133111EB & _MASK
    return (x ^ (x >> 29)) < threshold


def mixed(key, n):
    """A 64-bit hash of a key and a number, both of Python or arrays of numpy."""
    x = (key + (n + 1) * _STEP) & _MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def agenda_of_heap(at: list[str], merges: dict[str, tuple[float, int]], key: int, threshold: int) -> list[str]:
    """Merge one word's symbols, best candidate first, leftmost of equals; the agenda is a heap over linked symbols."""
    n = len(at)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    agenda: list[tuple[tuple[float, int], int, int, str]] = []

    def offer(left: int, right: int) -> None:
        if (found := merges.get(at[left] + at[right])) is not None:
            heapq.heappush(agenda, (found, left, right, at[left] + at[right]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        found, left, right, piece = heapq.heappop(agenda)
        if not alive[left] or after[left] != right or at[left] + at[right] != piece:
            continue
        if threshold and skipped(key, found[1], left, threshold):
            continue
        at[left], alive[right] = piece, False
        after[left] = nxt = after[right]
        if nxt < n:
            before[nxt] = left
            offer(left, nxt)
        if before[left] >= 0:
            offer(before[left], left)
    return [p for p, a in zip(at, alive) if a]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            data = np.empty(2 * end, dtype=self.data.dtype)  # its free half takes no memory until it is written
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : end] = values
        self.n = end

    def __getitem__(self, at):
        return self.data[at]


class Agendas:
    """The agendas of many short words at once, over symbols as numbers.

    A symbol is the id of its piece; other characters have numbers of their own, from ``n_ids`` on. ``pairs``
    are the pairs of symbols that make a piece, sorted, with that piece's rank.
    """

    def __init__(self, merges: dict[str, tuple[float, int]], ids: dict[str, int], n_ids: int):
        self.n_ids = n_ids
        #: The symbol of every code point; a space is the mark, and the mark itself a character without a piece.
        self.symbols = np.arange(n_ids, n_ids + 0x110000, dtype=np.int32)
        for text, i in ids.items():
            if len(text) == 1:
                self.symbols[ord(text)] = i
        self.symbols[ord(" ")], self.symbols[ord(SPACE)] = self.symbols[ord(SPACE)], n_ids + ord(SPACE)
        single = lambda c: ids.get(c, n_ids + ord(c))
        ranked = sorted(merges, key=merges.get)
        self.made = np.array([ids[p] for p in ranked], dtype=np.int32)
        pairs = []
        for rank, p in enumerate(ranked):
            for cut in range(1, len(p)):
                halves = p[:cut], p[cut:]
                if all(len(h) == 1 or h in merges for h in halves):
                    left, right = (single(h) if len(h) == 1 else ids[h] for h in halves)
                    pairs.append((left << 32 | right, rank))
        pairs = np.array(sorted(pairs) or [(-1, NO_RANK)], dtype=np.int64)
        self.pairs, self.ranks = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs of symbols make; a negative symbol is none."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.ranks[at], NO_RANK).astype(np.int32)

    def run(self, at: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        """Merge each row of symbols (padded with -1) in place, best candidate first, leftmost of equals.

        Candidates are numbered as they come up; the ones in the row of ``left_out`` are skipped, and their
        symbols may merge with other neighbours later. Returns how many each row had.
        """
        n, width = at.shape
        seen = np.zeros(n, dtype=np.int32)
        if width < 2:
            return seen
        rank = np.full((n, width), NO_RANK, dtype=np.int32)  # its last column stays empty
        row, column = np.nonzero(at[:, 1:] >= 0)
        rank[row, column] = self.rank(at[row, column], at[row, column + 1])
        rows, columns = np.arange(n), np.arange(width)[None, :]
        while True:
            own = rank[rows]
            best_at = own.argmin(axis=1)
            best = own[np.arange(len(rows)), best_at]
            more = best < NO_RANK
            rows, best_at, best = rows[more], best_at[more], best[more]
            if not len(rows):
                return seen
            skip = (left_out[rows] == seen[rows, None]).any(axis=1)
            seen[rows] += 1
            rank[rows[skip], best_at[skip]] = NO_RANK
            r, p, piece = rows[~skip], best_at[~skip], self.made[best[~skip]]
            beyond = columns > p[:, None]
            for table, end in ((at, -1), (rank, NO_RANK)):
                old = table[r]
                moved = np.full_like(old, end)
                moved[:, :-1] = old[:, 1:]
                table[r] = np.where(beyond, moved, old)
            at[r, p] = piece
            rank[r, p] = self.rank(piece, at[r, np.minimum(p + 1, width - 1)])
            some = p > 0
            rank[r[some], p[some] - 1] = self.rank(at[r[some], p[some] - 1], piece[some])


class PieceCoder:
    """Encodes and decodes with the pieces of a SentencePiece merge model.

    White space becomes a mark that starts each word, and no piece has that mark after another character,
    so words are encoded one by one. Within a word, candidate merges wait in an agenda ordered by piece
    rank, then position. With ``dropout`` over 0, each candidate of each word of a text is skipped with that
    chance, by a hash of the text's key and the word's place in it, so no two occurrences are bound to be cut
    alike; its symbols may still merge with other neighbours later. What is remembered of a word is its
    pieces by the candidates left out, which cuts nothing from the choice. What stays
    unmerged and has no piece is spelled in byte pieces, and so is the mark itself where a text holds it, so
    decoding gives the very text back.
    """

    def __init__(self, model: bytes, dropout: float = 0.0):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        #: Rank and id of every piece that a merge can make.
        self.merges = {p: (-proto.pieces[i].score, i) for p, i in self.ids.items() if len(p) > 1}
        self.agendas = Agendas(self.merges, self.ids, len(proto.pieces))
        self.byte = [0] * 256
        self.spelled: list[bytes] = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.spelled[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.piece in self.ids:
                self.spelled[i] = p.piece.replace(SPACE, " ").encode()
        self.threshold = int(dropout * (1 << 64))
        #: Turns the log of a uniform number into how many candidates are kept before the next one is skipped.
        self.scale = 0.0 if dropout >= 1 else 1 / math.log1p(-dropout) if dropout > 0 else -math.inf
        self.forget()

    def forget(self) -> None:
        #: A cutting is a number: of a word without candidates left out, or of a cutting with one more left out.
        self.whole: dict[str, int] = {}
        self.cut_codes, self.cut_numbers = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        #: Of each cutting its word's symbols, the cutting before and the candidate left out of it (-1 for none),
        #: how many candidates came up, and its ids; ``letters`` and ``pool`` hold symbols and ids.
        self.letter_at, self.n_letters, self.parent, self.gap, self.candidates, self.id_at, self.n_ids = (Grown(np.int32) for _ in range(7))
        self.letters, self.pool = Grown(np.int32), Grown(np.int32)

    def add_words(self, words: list[str]) -> range:
        """Numbers of the cuttings of short words without candidates left out."""
        sizes = np.array(list(map(len, words)), dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = self.letters.n + np.cumsum(sizes) - sizes
        self.letters.extend(self.agendas.symbols[points])
        none = np.full(len(words), -1)
        return self.add(starts, sizes, none, none)

    def add_cuts(self, codes: np.ndarray) -> range:
        """Numbers of new cuttings, by the number of the one before and the candidate to be left out as well."""
        parent = codes // MOST
        return self.add(self.letter_at[parent], self.n_letters[parent], parent, codes % MOST)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the cuttings of ``codes`` (sorted, as in ``add_cuts``), made where there are none yet."""
        at = np.searchsorted(self.cut_codes, codes)
        there = at < len(self.cut_codes)
        there[there] = self.cut_codes[at[there]] == codes[there]
        if not there.all():
            new = self.add_cuts(codes[~there])
            self.cut_codes = np.insert(self.cut_codes, at[~there], codes[~there])
            self.cut_numbers = np.insert(self.cut_numbers, at[~there], np.arange(new.start, new.stop))
            at = np.searchsorted(self.cut_codes, codes)
        return self.cut_numbers[at]

    def add(self, starts: np.ndarray, sizes: np.ndarray, parent: np.ndarray, gap: np.ndarray) -> range:
        first, n = self.letter_at.n, len(starts)
        candidates, id_at, n_ids = (np.zeros(n, dtype=np.int64) for _ in range(3))
        for low, high in ((0, 5), (5, 7), (7, 9), (9, 12), (12, 17), (17, SHORT)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in (rows[i : i + 8192] for i in range(0, len(rows), 8192)):
                columns = np.arange(sizes[part].max())[None, :]
                there = columns < sizes[part][:, None]
                at = np.where(there, self.letters[np.where(there, starts[part][:, None] + columns, 0)], np.int32(-1))
                gone, before = [gap[part]], parent[part]
                while (before >= 0).any():
                    gone.append(np.where(before >= 0, self.gap[before], -1))
                    before = np.where(before >= 0, self.parent[before], -1)
                candidates[part] = self.agendas.run(at, np.stack(gone, axis=1))
                id_at[part], n_ids[part] = self.keep(at)
        for table, values in zip((self.letter_at, self.n_letters, self.parent, self.gap, self.candidates, self.id_at, self.n_ids), (starts, sizes, parent, gap, candidates, id_at, n_ids)):
            table.extend(values)
        return range(first, first + n)

    def keep(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of merged symbols into the pool; (where each row's begin, how many they are)."""
        row, column = np.nonzero(at >= 0)
        ids, times = at[row, column], np.ones(len(row), dtype=np.int64)
        if (other := np.flatnonzero(ids >= self.agendas.n_ids)).size:
            spelled = [self.bytes_of(chr(c)) for c in (ids[other] - self.agendas.n_ids).tolist()]
            times[other] = list(map(len, spelled))
            ids, starts = np.repeat(ids, times), np.cumsum(times) - times
            for i, own in zip(other.tolist(), spelled):
                ids[starts[i] : starts[i] + len(own)] = own
        sizes = np.bincount(row, weights=times, minlength=len(at)).astype(np.int64)
        starts = self.pool.n + np.cumsum(sizes) - sizes
        self.pool.extend(ids)
        return starts, sizes

    def bytes_of(self, symbol: str) -> list[int]:
        return [self.byte[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def add_long(self, word: str, key: int) -> int:
        """Number of the cutting of one long word; it isn't asked for again."""
        at = [RAW if c == SPACE else c for c in word]
        spaces = len(word) - len(word.lstrip(" "))
        at[:spaces] = SPACE * spaces
        ids: list[int] = []
        for piece in agenda_of_heap(at, self.merges, key, self.threshold):
            ids.extend((i,) if (i := self.ids.get(piece)) is not None else self.bytes_of(SPACE if piece == RAW else piece))
        values = (0, 0, -1, -1, 0, self.pool.n, len(ids))
        self.pool.extend(np.array(ids))
        for table, value in zip((self.letter_at, self.n_letters, self.parent, self.gap, self.candidates, self.id_at, self.n_ids), values):
            table.extend(np.array([value]))
        return self.letter_at.n - 1

    def gaps(self, keys: np.ndarray, places: np.ndarray, draw: int) -> np.ndarray:
        """For words in these places, how many candidates are kept before the next one is skipped."""
        with np.errstate(over="ignore"):
            x = mixed(mixed(keys.astype(np.uint64), np.uint64(draw)), places.astype(np.uint64))
        return (np.log1p((x >> np.uint64(11)).astype(float) * -(2.0**-53)) * self.scale).astype(np.int64)

    def encode_many(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); an empty text has none."""
        if self.letter_at.n >= REMEMBERED or self.pool.n >= REMEMBERED_IDS:
            self.forget()
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        counts = np.array([len(ws) for ws in split])
        of = np.repeat(np.arange(len(texts)), counts)
        places = np.arange(len(words)) - (np.cumsum(counts) - counts)[of]
        keys_of = np.array([k & _MASK for k in keys], dtype=np.uint64)[of]
        new = [w for w in set(words).difference(self.whole) if len(w) <= SHORT]
        self.whole.update(zip(new, self.add_words(new)))
        found = list(map(self.whole.get, words))
        if None in found:
            for i, number in enumerate(found):
                if number is None:
                    found[i] = self.add_long(words[i], mixed(int(keys_of[i]), int(places[i])))
        cutting = np.array(found, dtype=np.int64)
        if self.threshold:
            gap = self.gaps(keys_of, places, 0)
            open_ = np.flatnonzero(gap < self.candidates[cutting])
            draw = 1
            while len(open_):
                codes, back = np.unique(cutting[open_] * MOST + gap[open_], return_inverse=True)
                cutting[open_] = self.cuts(codes)[back]
                gap[open_] += 1 + self.gaps(keys_of[open_], places[open_], draw)
                open_ = open_[gap[open_] < self.candidates[cutting[open_]]]
                draw += 1
        sizes, starts = self.n_ids[cutting], self.id_at[cutting]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]
        return ids, np.bincount(of, weights=sizes, minlength=len(texts)).astype(np.int64)

    def encode(self, text: str, key: int = 0) -> bytes:
        """Ids as little-endian 32-bit integers; an empty text has none."""
        return self.encode_many([text], [key])[0].astype("<i4").tobytes()

    def decode(self, ids: bytes) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in np.frombuffer(ids, dtype="<i4").tolist()])[1:].decode()


_CODERS: dict[tuple, PieceCoder] = {}


def coder(model: bytes, dropout: float) -> PieceCoder:
    """One coder for each Python worker, with the words it knows."""
    key = (hashlib.sha256(model).digest(), dropout)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(model, dropout)
    return _CODERS[key]


def key_of(doc_id: int | None, text: str, seed: int) -> int:
    """The hash key of a document, whose text tells apart rows without an id or with the same one."""
    return xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(repr(doc_id), seed & _MASK))


def slices(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of at most ``most`` characters, or of one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held + len(text) > most and i > start:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if len(texts) > start:
        yield slice(start, len(texts))


def encode_batch(own: PieceCoder, batch: pa.RecordBatch, seed: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``encode_documents`` for a batch of (doc_id, text), in batches of ``AT_ONCE`` characters."""
    doc_ids, all_texts = (c.to_pylist() for c in batch.columns)
    for part in slices(all_texts, AT_ONCE):
        texts = all_texts[part]
        ids, sizes = own.encode_many(texts, [key_of(d, t, seed) for d, t in zip(doc_ids[part], texts)])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        read = [own.decode(ids[a:b].tobytes()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)[part], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes), pa.array(read, type=pa.string())],
            names=["doc_id", "ids", "n_pieces", "decoded"],
        )


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str = MODEL,
    dropout: float = 0.1,
    seed: int = 1,
) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, decoded) for every row.

    ``decoded`` is the text read back from ``ids`` alone. Merges are skipped by a hash keyed with ``seed``,
    the document and the word's place in it: the same seed always gives the same ids, another seed other
    segmentations, and a word is cut anew wherever it occurs; dropout 0 gives the model's own. The model file is read on the driver and sent along. A
    null text counts as empty: no ids, decoded empty. Repeated rows stay and are cut alike;
    other columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, dropout)
        for batch in batches:
            yield from encode_batch(own, batch, seed)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, decoded string")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) from rows (doc_id, ids); null or no ids give an empty text."""
    with open(model_path, "rb") as f:
        model = f.read()
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, 0.0)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype="<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Pieces of every document, with the digest of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return encode_documents(docs).select("doc_id", "ids", "n_pieces", F.sha2("decoded", 256).alias("decoded_sha256"))
