"""Source divergence audit: groups stay where they are while peers' vectors visit them in tournament rounds."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import arrow_schema, as_batch, as_bytes, bounded_batches, discard, store

#: Documents of a language that must hold a term, and terms that are ranked of a group.
LEAST_DOCS, TOP = 3, 200
#: A slice of a language's vocabulary has about so many terms; a vector is one group's counts in one slice.
SLICE = 32_768
#: So many rounds circulate at once; more are taken one such block after the other, to bound what lies on disk.
ROUNDS = 32
#: A task holds so many counts of terms before it hands them on.
HELD = 400_000
SCALE = 1_000_000_000

#: Every byte of a text that is no part of a term (A-Z, a-z, or of a character beyond ASCII) becomes a blank; A-Z become a-z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_MEETINGS = "lang string, slice int, seat int, peer int, idx int, value long"
_RESIDENT, _WHOLE = -2, -1


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often a group has a term, and in how many of its documents.

    Each task sums up what it reads, as far as ``HELD`` counts go, before the shuffle.
    """
    bounded_batches(docs.sparkSession)
    target = arrow_schema(docs.sparkSession, _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, seen) in held.items():
                rows = list(counts.items())
                for at in range(0, len(rows), 8192):
                    yield as_batch([(lang, source, term, n, seen[term]) for term, n in rows[at : at + 8192]], target)

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = terms(text)
                if found:
                    counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    before = len(counts)
                    counts.update(found)
                    seen.update(set(found))
                    size += (len(counts) - before) * (1 + len(text) // (64 * len(found)))  # long terms count for more
                    if size > HELD:
                        yield from handed()
                        held, size = {}, 0
        yield from handed()

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    rows = docs.select(names[0].alias("lang"), names[1].alias("source"), as_bytes(text_col).alias("text")).mapInArrow(run, _COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def packed(idx: np.ndarray, n: np.ndarray) -> bytes:
    """A vector's terms (their numbers in the slice, ascending, as steps) and counts, compressed."""
    steps = np.diff(idx.astype(np.int32), prepend=np.int32(0))
    return zlib.compress(steps.tobytes() + n.astype(np.int64).tobytes(), 1)


def unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if vector is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw = zlib.decompress(vector)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int32, n)).astype(np.int64), np.frombuffer(raw, np.int64, n, 4 * n)


def scaled(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), by long division in steps of a thousand, exact below 9 x 10^15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def measure(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Group:
    """One group's counts in one slice, and its shares p."""

    def __init__(self, vector: bytes | None, n: int, v: int):
        self.idx, self.counts = unpacked(vector)
        self.p = scaled(self.counts, n + v) if v else self.counts
        self.none = int(scaled(np.zeros(1, dtype=np.int64), n + v)[0]) if v else 1

    def meet(self, other: Group, n_terms: int) -> tuple[int, int]:
        """Sums of the measure over all terms of the slice, of this group against the other, and the other way round."""
        union = np.union1d(self.idx, other.idx)
        p, q = np.full(len(union), self.none), np.full(len(union), other.none)
        p[np.searchsorted(union, self.idx)] = self.p
        q[np.searchsorted(union, other.idx)] = other.p
        ends = np.array([self.none]), np.array([other.none])
        rest = n_terms - len(union)
        return int(measure(p, q).sum()) + rest * int(measure(*ends)[0]), int(measure(q, p).sum()) + rest * int(measure(*ends[::-1])[0])

    def typical(self, whole: Group) -> list[tuple[int, int]]:
        """(term, value) of the terms that the group has more often than its language, at most ``TOP`` from the largest."""
        q = whole.p[np.searchsorted(whole.idx, self.idx)]
        more = self.p > q
        values = measure(self.p[more], q[more])
        best = heapq.nsmallest(TOP, zip((-values).tolist(), self.idx[more].tolist()))
        return [(i, -v) for v, i in best]


def _visits(first: int, last: int) -> str:
    """SQL: (host, round) of the seats that a seat's vector visits in the rounds from ``first`` to before ``last``.

    Of an odd number m of seats, i and j meet in round (i + j) mod m, at the seat from which the other is at most
    (m - 1) / 2 seats on; with an even number the last seat meets i in round 2i mod m, at i where i is even and at the last
    seat otherwise. So each pair meets once, no seat meets two others in a round, and each hosts about as many.
    """
    steps = "filter(sequence(0, (m - 1) DIV 2), d -> d > 0)"
    circle = f"transform({steps}, d -> struct(pmod(seat - d, m) AS host, pmod(2 * seat - d, m) AS round))"
    nothing = "filter(array(struct(0 AS host, 0 AS round)), x -> false)"
    at_last = f"IF(seats > m AND seat % 2 = 1, array(struct(m AS host, pmod(2 * seat, m) AS round)), {nothing})"
    of_last = "transform(filter(sequence(0, m - 1), i -> i % 2 = 0), i -> struct(i AS host, pmod(2 * i, m) AS round))"
    own = f"array(struct(seat AS host, {_RESIDENT} AS round))"
    return f"concat({own}, filter(IF(seat = m, {of_last}, concat({circle}, {at_last})), x -> x.round >= {first} AND x.round < {last}))"


def meetings(vectors: DataFrame) -> DataFrame:
    """(_MEETINGS): what rows (lang, slice, n_terms, host, round, seat, n, v, vector) give where they meet.

    The rows of a host come to one task, its own vector first; each visitor is held against it in both directions
    and let go, so a task holds two vectors. A visit of the whole language ranks the host's terms.
    """
    bounded_batches(vectors.sparkSession)
    target = arrow_schema(vectors.sparkSession, _MEETINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        resident = None
        for batch in batches:
            for lang, part, n_terms, host, turn, seat, n, v, vector in zip(*(c.to_pylist() for c in batch.columns)):
                group = Group(vector, n, v)
                if turn == _RESIDENT:
                    resident = group
                elif turn == _WHOLE:
                    out.extend((lang, part, host, None, i, value) for i, value in resident.typical(group))
                else:
                    there, back = resident.meet(group, n_terms)
                    out += [(lang, part, host, seat, None, there), (lang, part, seat, host, None, back)]
                if len(out) >= 8192:
                    yield as_batch(out, target)
                    out = []
        if out:
            yield as_batch(out, target)

    columns = ["lang", "slice", "n_terms", "host", "round", "seat", "n", "v", "vector"]
    dealt = vectors.repartition("lang", "slice", "host").sortWithinPartitions("lang", "slice", "host", "round")
    return dealt.select(columns).mapInArrow(run, _MEETINGS)


def _vectors(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, idx, n) as one packed vector for each key."""

    def pack(rows: pd.Series) -> pd.Series:
        return pd.Series([packed(np.array([r["idx"] for r in own]), np.array([r["n"] for r in own])) for own in rows], dtype=object)

    lists = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("_rows"))
    return lists.select(*keys, F.pandas_udf(pack, "binary")("_rows").alias("vector"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", slice_terms: int = SLICE, rounds: int = ROUNDS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    Part ``pair`` has every other source of the language with the sum of the measure over all kept terms; part
    ``term`` the ``TOP`` terms that the source has more often than its language. Terms are runs of letters A-Z and
    of characters beyond ASCII, A-Z lower-cased; those in at least ``LEAST_DOCS`` rows of a language are kept. Null text,
    lang and source count as ''; every row is a document of its own, repeated or without an id; equal values are
    ranked by item. A language with one source has no pairs, one without kept terms has pairs of value 0. Other columns are
    ignored; an empty table gives an empty result. Sources of a language (one row each) are numbered in one task.
    """
    counts = store(term_counts(docs, lang_col, source_col, text_col), "counts")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    groups = docs.select(names[0].alias("lang"), names[1].alias("source")).distinct()
    kept = store(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.count("*").cast("int").alias("seats")).join(sizes, "lang", "left").na.fill(0, ["v", "n"])
    langs = store(langs.withColumn("slices", F.expr(f"CAST(greatest(1, -(-v DIV {slice_terms})) AS INT)")), "langs")
    numbered = Window.partitionBy("lang", "slice").orderBy("term")
    cut = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.expr("CAST(pmod(xxhash64(term), slices) AS INT)"))
    words = store(cut.select("lang", "slice", (F.row_number().over(numbered) - 1).alias("idx"), "term", "n"), "terms")
    own = counts.select("lang", "source", "term", "n").join(words.select("lang", "term", "slice", "idx"), ["lang", "term"])
    own = store(_vectors(own, ["lang", "source", "slice"]), "vectors")
    # what a group has of kept terms, from its vectors
    total = F.pandas_udf(lambda vectors: pd.Series([int(unpacked(v)[1].sum()) for v in vectors], dtype="int64"), "bigint")
    totals = own.select("lang", "source", total("vector").alias("n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    seat = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("seat")
    seated = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["n"]).select("lang", "source", "n", seat)
    seated = store(seated.join(langs.select("lang", "seats", "v", "slices"), "lang"), "seats")
    n_terms = words.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("n_terms"))
    chunks = seated.select("lang", "source", "seat", "seats", "n", "v", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
    chunks = chunks.join(own, ["lang", "source", "slice"], "left").join(n_terms, ["lang", "slice"], "left").na.fill(0, ["n_terms"])
    chunks = store(chunks.withColumn("m", F.expr("seats - 1 + seats % 2")), "chunks")
    whole = _vectors(words, ["lang", "slice"]).join(langs, "lang").join(n_terms, ["lang", "slice"])
    whole = whole.select("lang", "slice", "n_terms", F.explode(F.expr("sequence(0, seats - 1)")).alias("host"), F.lit(_WHOLE).alias("round"), F.lit(-1).alias("seat"), "n", "v", "vector")
    last = chunks.agg(F.max("m")).first()[0] or 0
    met, columns = [], ["lang", "slice", "n_terms", "host", "round", "seat", "n", "v", "vector"]
    for first in range(0, last, rounds):
        visits = chunks.withColumn("_visit", F.explode(F.expr(_visits(first, first + rounds))))
        sent = visits.select("lang", "slice", "n_terms", "_visit.host", "_visit.round", "seat", "n", "v", "vector")
        met.append(store(meetings(sent if first else sent.unionByName(whole.select(columns))), "met"))
    for table in (counts, kept, own, chunks):
        discard(table)
    if not met:
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    results = met[0]
    for table in met[1:]:
        results = results.unionByName(table)
    sources = seated.select("lang", "seat", "source")
    pairs = results.where("peer IS NOT NULL").groupBy("lang", "seat", "peer").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sources, ["lang", "seat"]).join(sources.select("lang", F.col("seat").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    tops = results.where("idx IS NOT NULL").join(words.select("lang", "slice", "idx", F.col("term").alias("item")), ["lang", "slice", "idx"]).join(sources, ["lang", "seat"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    tops = tops.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= TOP)
    return pairs.unionByName(tops)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its typical terms."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


#: The contract of op11 in DuckDB's SQL.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(tot.total, 0) + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS whole
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - whole) * (p - whole) // whole)::BIGINT AS value
  FROM p WHERE n > 0 AND p > whole),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
