"""Exact token counts as a histogram of encoded lengths, answered by suffix sums."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import map_texts, store

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts text before merging; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths whose suffix sums one task makes.
SPAN = 4096

_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes):
    """One encoder for each Python worker."""
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("gneiss", pat_str=PATTERN, mergeable_ranks=merge, special_tokens={})
    return _ENCODERS[key]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) for every row; null and empty texts have none, special strings are ordinary text."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))}
    return map_texts(
        docs,
        columns,
        lambda enc, doc_id, text: (doc_id, len(enc.encode_ordinary(text))),
        "doc_id long, n_tokens long",
        lambda: encoder(ranks),
    )


def length_histogram(counts: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for every length that occurs; combined on the map side, so no length is hot."""
    return counts.groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """For every length L that occurs, as a context limit:

    n_docs (of that length), docs_longer and tokens_longer (over L), docs_within and tokens_within (at most
    L), truncated_total (tokens left when every document is cut to L) and share_within (the share of
    documents of at most L tokens: where it first reaches q, L is the q-quantile). Sums run within spans of
    lengths and then over the spans' totals, so no task holds all lengths. An empty histogram gives no rows.
    """
    h = histogram.withColumn("span", F.floor(F.col("n_tokens") / span)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spans = spans.select(
        "span",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    later = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.join(spans, "span").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(later), F.lit(0)) + F.col("d_above")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(later), F.lit(0)) + F.col("t_above")).alias("tokens_longer"),
        "all_docs",
        "all_tokens",
    )
    return longer.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_within"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total, over) for any limits, whether a document has that length or not."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    rows = histogram.crossJoin(F.broadcast(asked))  # the limits asked for, a short list
    return rows.groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("total"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("over"),
    )


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """What every context limit keeps of all documents.

    The histogram is read twice, for the spans and for their lengths, so it is written once and the texts are
    encoded once.
    """
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return context_table(store(length_histogram(counts), "lengths"))
