import json
import math

import pytest
from tokenizers import Tokenizer

from gneiss.llm import lengths

TEXTS = ["", "one", "one two three", "naïve café 😀", "<|endoftext|>", "x " * 5000, "x " * 5000, "tab\tand\nline"]
OTHER = "/opt/tokenizers/byte_bpe_50k.json"


def counts(spark, rows):
    return lengths.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))


def test_counts_match_another_library(spark):
    other = Tokenizer.from_file(OTHER)
    other.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in counts(spark, [(i, t, "") for i, t in enumerate(TEXTS)]).collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_every_context_limit(spark):
    n = [0, 0, 1, 3, 3, 3, 9, 5000, 5001, 20000]
    df = spark.createDataFrame([(x,) for x in n], "n_tokens long")
    got = {r.context_limit: r for r in lengths.context_table(lengths.length_histogram(df), span=7).collect()}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        assert r.n_docs == n.count(limit)
        assert (r.docs_longer, r.tokens_longer) == (sum(x > limit for x in n), sum(x for x in n if x > limit))
        assert (r.docs_within, r.tokens_within) == (sum(x <= limit for x in n), sum(x for x in n if x <= limit))
        assert r.truncated_total == sum(min(x, limit) for x in n)
        assert math.isclose(r.share_within, sum(x <= limit for x in n) / len(n))
    asked = {r.context_limit: (r.total, r.over) for r in lengths.truncated_totals(lengths.length_histogram(df), [0, 2, 4096, 10**6]).collect()}
    assert asked == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (0, 2, 4096, 10**6)}


def test_nulls_and_empty_tables(spark):
    rows = [(None, "one two", ""), (1, None, ""), (1, None, "")]
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in counts(spark, rows).collect()) == [(0, 2), (1, 0), (1, 0)]
    empty = spark.createDataFrame([], "n_tokens long")
    assert lengths.context_table(lengths.length_histogram(empty)).collect() == []


def test_pattern_is_the_vocabularys():
    public = pytest.importorskip("public_tokenizers")
    assert lengths.PATTERN == public.PATTERN
    assert json.load(open(OTHER))["model"]["type"] == "BPE"
