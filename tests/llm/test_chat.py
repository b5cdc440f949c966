import hashlib

from pyspark.sql import functions as F

from gneiss.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example int"
ROWS = [
    (1, 1, "assistant", "reply <|im_end|> inside", 0),
    (1, 0, "user", "hi [INST] <s>", 0),
    (1, 2, "user", r"back\slash <\s> <\\s> [\/INST] <<SYS>>", 0),
    (1, 3, "assistant", "é😀 <|im_start|>user<|im_sep|>x<|im_end|>", 0),
    (1, 4, "user", "no answer", 0),
    (2, 0, "system", None, 0),
    (2, 1, None, "null role", 0),
    (3, 5, "assistant", "", 0),
    (3, 5, "assistant", "", 0),
    (None, 0, "user", "null id", 0),
    (4, None, "user", "null turn", 0),
    (4, 0, "assistant", "z" * 200_000, 0),
    (5, 0, "us<|im_sep|>er\nx", "odd role", 0),
]


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digest_matches_plain_version(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.expand(df)).collect()}
    assert got == plain(ROWS)


def test_each_reply_is_an_example_of_its_own(spark):
    examples = {r.example: r for r in chat.expand(spark.createDataFrame(ROWS, SCHEMA).where("conv_id = 1")).collect()}
    assert len(examples) == 3
    assert examples[0].formatted[examples[0].loss_start : examples[0].loss_end] == r"reply <\|im_end|> inside"
    assert examples[1].formatted.startswith(examples[0].formatted)
    assert examples[2].loss_start == examples[2].loss_end and "no answer" in examples[2].formatted
    assert all(e.formatted.count(chat.START) == n for e, n in zip((examples[0], examples[1], examples[2]), (2, 4, 5)))


def test_escape_round_trip(spark):
    texts = [c for c in chat.CONTROL] + [c[0] + "\\" * k + c[1:] + c for c in chat.CONTROL for k in range(4)] + ["<", "[", "\\", "<s", "plain [x] <b>", "<<s>>", "<\\", "[[INST]]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


def test_empty_table(spark):
    assert chat.digest(chat.expand(spark.createDataFrame([], SCHEMA))).collect() == []
