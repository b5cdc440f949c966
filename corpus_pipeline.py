"""A training-data pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import leaks, lines, pieces, quality, similar
from gneiss.llm.common import discard, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored as texts without words; rows without an id and repeated rows are scored
    like any other; without labels of both kinds all documents get the same score. Columns besides those of
    documents are left out, here and in the other stages; an empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.drop_low_quality(docs, labels).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share; n_chars follows the text.

    A null text becomes empty; rows without an id keep all lines and count for nothing; rows that share an id
    are one document.
    """
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that shares 0.8 of its five-word shingles.

    Texts without words are alike; rows without an id stay; rows that share an id stay or go together.
    """
    return similar.drop_near_duplicates(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, as do rows without an id; items without words match nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return leaks.drop_leaked(docs, benchmark).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document that is left, and the digest of the text decoded from them.

    A null text counts as empty; repeated rows are cut alike.
    """
    return pieces.op10_sentencepiece(spark, sf_dir, docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The first stage learns a network, which SQL cannot express; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)  # the copy after it holds all that is left
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
