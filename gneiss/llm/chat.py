"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates and tokenizers treat as control; none survives inside a text.
CONTROL = (START, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_TAILS = "|".join(sorted((r"\Q" + c[1:] + r"\E" for c in CONTROL), key=len, reverse=True))


def escape(text: Column) -> Column:
    r"""Put one more backslash after the first character of every control string (``<s>`` to ``<\s>``)."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_TAILS})", "$1$2")


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, role, text).

    A null role or text counts as empty, ties of turn are ordered by role and text, repeated rows stay; rows
    whose conv_id is null form one conversation of their own.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def expand(rows: DataFrame) -> DataFrame:
    """Training examples (conv_id, example, formatted, loss_start, loss_end).

    Every assistant turn becomes an example of its own: all turns before it as context, then its reply, the
    only text under the loss mask, which is the half-open range of code points [loss_start, loss_end) of
    ``formatted``. A conversation that ends otherwise has one more example of all its turns with an empty
    mask, so that no turn is lost. A turn is written as start mark, role, separator, text, end mark; control
    strings inside roles and texts are escaped reversibly. An empty table gives no examples.

    By its nature the output grows with the square of a conversation's turns; each example is made on its
    own, so memory holds one conversation and one example.
    """
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("reply"),
            F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    written = conversation_turns(rows).select("conv_id", pieces.alias("p"))
    last = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i == F.size("p")) | F.element_at("p", i.cast("int"))["reply"])
    examples = written.select("conv_id", "p", F.posexplode(last).alias("example", "n"))
    context = F.array_join(
        F.transform(F.slice("p", F.lit(1), F.col("n") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
    )
    target = F.element_at("p", F.col("n"))
    parts = examples.select("conv_id", "example", F.concat(context, target["head"]).alias("before"), target.alias("t"))
    start = F.char_length("before")
    return parts.select(
        "conv_id",
        "example",
        F.concat("before", "t.body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("t.reply"), start + F.char_length("t.body")).otherwise(start).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds."""
    parts = F.split(formatted, rf"\Q{END}\E", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = F.transform(turns, lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), rf"\Q{MIDDLE}\E", 2))
    return F.transform(body, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, end - start))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and characters written."""
    per = examples.select(
        "conv_id",
        "example",
        "formatted",
        F.char_length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    conv = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = conv.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    canonical = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(canonical, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digest of every conversation's examples, and of one whose texts are control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], rows.schema)
    return digest(expand(rows.unionByName(extra)))


#: The characters that may follow the first one in ``CONTROL``, as DuckDB's patterns write them.
_SQL_TAILS = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|endoftext\|>"


def op5_sql() -> str:
    """Contract of op5 in DuckDB's SQL; formatted_chars counts each example's prefix of turns and their marks."""
    size = rf"length(regexp_replace({{0}}, '([<\[])(\\*)({_SQL_TAILS})', '\1\2x\3', 'g'))"
    marks = len(START) + len(MIDDLE) + len(END)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, {size.format('role')} + {size.format('text')} + {marks} AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM rows),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR n = n_turns) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
