"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import map_texts, remainder

#: What the dictionaries are fitted on: so many documents of each language at most, chosen by a hash of
#: their id, and so many bytes of their text. Everything else covers all documents.
SAMPLE_DOCS, DICTIONARY_BYTES = 200, 48 << 10
#: A table with more languages is refused: every text is compressed once for each.
MAX_LANGUAGES = 500
#: Texts are compressed in blocks of so many bytes, so that a long text keeps being compared with the
#: dictionaries and not with its own beginning.
BLOCK, LEVEL = 4096, 6
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_BETWEEN = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-case words with single spaces: marks, digits and shouting say nothing about the language."""
    return f" {_BETWEEN.sub(' ', text.lower())} ".encode("utf-8", "replace")


def sample_ids(docs: DataFrame, learn, id_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(id, lang, n) of at most ``per_language`` documents of each language, smallest hash of id first, and how many they are.

    Only ids, languages and hashes move; the limit is applied before the shuffle too, so a language with
    most documents makes no hot task.
    """
    rank = Window.partitionBy("lang").orderBy("h", "id")
    rows = docs.where(learn).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("h"))
    chosen = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_language).select("id", "lang").distinct()
    return chosen.withColumn("n", F.count("*").over(Window.partitionBy("lang")))


def fit(
    docs: DataFrame,
    learn,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> list[tuple[str, bytes]]:
    """[(language, dictionary)], the commonest language first.

    ``learn`` is the condition on rows that may be learned from. The sample is gathered on the driver:
    languages x ``sample_docs`` documents, of each a stretch of its text that is four times its share of its
    language's dictionary, from a place given by a hash of its id. Of rows that share an id and a language the largest
    stretch counts. More than ``MAX_LANGUAGES`` languages are an error.
    """
    learn = learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    known = docs.where(learn).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    chosen = sample_ids(docs, learn, id_col, lang_col, sample_docs).select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("n").alias("_n"))
    share = F.greatest(F.lit(256), F.floor(F.lit(dictionary_bytes * 4) / F.col("_n"))).cast("int")
    rows = docs.where(learn).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    begin = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.char_length("text") - share, F.lit(0)) + 1).cast("int") + 1
    met = rows.join(F.broadcast(chosen), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    texts = met.groupBy("lang", "id").agg(F.max(F.substr(F.col("text"), begin, share)).alias("text")).collect()
    # lines that several documents share (notices, boilerplate) belong to no language
    shared = Counter(line for r in texts for line in set(r.text.split("\n")))
    out = []
    for lang in sorted(known, key=lambda r: (-r.n, r.lang)):
        parts, size = [], 0
        for r in sorted((r for r in texts if r.lang == lang.lang), key=lambda r: (r.id, r.text)):
            part = normal(" ".join(line for line in r.text.split("\n") if shared[line] == 1))
            if size + len(part) > dictionary_bytes:
                break
            parts.append(part)
            size += len(part)
        out.append((lang.lang, b"".join(parts)))
    return out


class Models:
    """A compressor for each language, made once in each task."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int):
        self.langs = [lang for lang, _ in dictionaries]
        self.compress = []
        for _, content in dictionaries:
            own = zstandard.ZstdCompressionDict(content or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=own, level=level, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes of the whole text for each language."""
        view = memoryview(text)
        blocks = [view[i : i + BLOCK] for i in range(0, len(view), BLOCK)]
        return [sum(len(compress(b)) for b in blocks) for compress in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is how much larger the second smallest encoding is."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(normal(text))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        # code lengths are log likelihoods; a quarter of a bit for each byte saved keeps scores below 1
        weights = [math.exp(-0.25 * (s - sizes[best])) for s in sizes]
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], 1 / sum(weights), (second - sizes[best]) / max(1, sizes[best])


def identify(
    docs: DataFrame, dictionaries: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01, level: int = LEVEL
) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for every row, from whole texts.

    lang_pred is the language whose dictionary gives the smallest encoding (of equals, the commoner one),
    ``und`` where the text is null or has no letter, or nothing was learned. ``rejected`` marks margins
    below ``min_margin`` and ``und``. Rows whose id is null and repeated rows stay; other columns are ignored.
    """
    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}

    def row(models: Models, doc_id: int, text: str | None) -> tuple:
        lang, score, margin = models.predict(text)
        return doc_id, lang, score, margin, lang == UNKNOWN or margin < min_margin

    return map_texts(docs, columns, row, "doc_id long, lang_pred string, score double, margin double, rejected boolean", lambda: Models(dictionaries, level))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of them is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = fit(docs, remainder("doc_id", 4) != 2)
    out = identify(docs, dictionaries)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
