import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from gneiss.llm import lines

SCHEMA = "doc_id long, text string, keep string"


def plain(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (len(h := holders.get(key(x), ())) >= 3 and d != max(h))]
        out[d] = (len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def fixture():
    rng = random.Random(1)
    shared = [f"shared line number {i} with words é" for i in range(12)] + ["x" * 19, "é" * 19, "É" * 20, "😀" * 5, " Padded  LINE of more than twenty \t"]
    rows = []
    for d in range(300):
        own = [rng.choice(shared) if rng.random() < 0.6 else f"own {d} {i} {rng.random()}" for i in range(rng.randint(1, 9))]
        rows.append((d * 3, "\n".join(own)))
    rows += [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "padded  line of MORE than twenty"), (5004, "a\n" * 5000 + shared[0])]
    return rows


def got(df):
    out = lines.dedup_lines(df)
    return {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("sha")).collect()}


def test_matches_plain_version(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert got(df) == plain(rows)
    assert set(lines.dedup_lines(df).columns) == {"doc_id", "text", "keep", "n_lines", "n_dropped"}


def test_a_hot_line_over_many_partitions(spark):
    rows = [(i, "the very same line everywhere\n" + f"own line of document {i} is long") for i in range(2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_null_ids_repeats_and_empty_tables(spark):
    line = "a line of twenty characters or more"
    rows = [(None, line, ""), (1, line, ""), (2, line, ""), (3, line, ""), (3, line, ""), (1, "other\n" + line, "")]
    out = sorted((r.doc_id or -1, r.text, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(-1, line, 0), (1, "", 1), (1, "other", 1), (2, "", 1), (3, line, 0), (3, line, 0)]
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bitmap_round_trip():
    import pandas as pd

    keep = lines._pack(pd.Series([[1, 4]]))[0]
    assert lines.apply_bitmap(b"a\nb\nc\nd\ne\nf", keep) == b"a\nc\nd\nf"
    assert lines.apply_bitmap(b"a\nb", None) == b"a\nb"
