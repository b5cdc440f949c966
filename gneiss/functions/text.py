"""Text functions as Column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a description.
STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "un", "una", "y", "o", "u", "en", "con", "sin", "por", "para", "que", "se",
    "su", "sus", "al", "lo", "le", "es", "son", "ha", "han", "como", "más", "menos", "este", "esta", "estos", "estas",
    "ese", "esa", "eso", "a",
)


def normalize_code_word(code: Column) -> Column:
    """Letters, digits and underscores in lower case."""
    return F.lower(F.regexp_replace(code, r"[^\p{L}\p{N}_]", ""))


def normalize_code_digits(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "")


def pad(number: Column, width: int = 2) -> Column:
    """Zero-padded on the left, never cut."""
    return F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0"))


def normalize_code_pad(code: Column) -> Column:
    """``C?n.n(.n)`` with every number padded to two digits; anything else unchanged, upper case."""
    clean = F.upper(F.trim(code))
    pattern = r"^C?(\d+)\.(\d+)(?:\.(\d+))?$"
    part = lambda i: F.regexp_extract(clean, pattern, i)
    joined = F.concat(pad(part(1)), F.lit("."), pad(part(2)), F.when(part(3) != "", F.concat(F.lit("."), pad(part(3)))).otherwise(""))
    return F.when(clean.rlike(pattern), joined).otherwise(clean)


def chapter_code_of(code: Column) -> Column:
    """Chapter before the first dot, zeros stripped and padded to two (``00`` for zero); null without a dot."""
    head = F.ltrim(F.trim(F.substring_index(code, ".", 1)), F.lit("0"))
    return F.when(F.contains(code, F.lit(".")), pad(head))


def chapter_prefix(name: Column) -> Column:
    """Letters with digits, else digits, else a Roman number, else the first word of a chapter name."""
    s = F.upper(F.trim(name))
    lettered = F.regexp_replace(F.regexp_extract(s, r"^([A-ZÁÉÍÓÚÑ]+[\s\-\.]?\d[\d\.]*)", 1), r"[\s\.\-]", "")
    digits = F.replace(F.regexp_extract(s, r"^(\d[\d\.]*)", 1), F.lit("."), F.lit(""))
    roman = F.regexp_extract(s, r"^([IVXLCDM]+)[\.\s]?", 1)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (lettered, digits, roman, F.split(s, " ")[0])), F.lit(""))


def token_set(text: Column) -> Column:
    """Distinct words of three characters or more, in lower case, without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-záéíóúñü0-9]{3,})"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def token_coverage(short: Column, long: Column) -> Column:
    """Share of the shorter text's words that the longer one has, of at least four words."""
    a, b = token_set(short), token_set(long)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(4)))


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the query's words of over two characters that the text contains."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def parse_es_number(text: Column, dots_always: bool = True) -> Column:
    """``1.234,56`` as a double; without a comma, dots group thousands only if ``dots_always``."""
    full = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    number = full if dots_always else F.when(F.contains(text, F.lit(",")), full).otherwise(text)
    return F.trim(number).try_cast("double")


def format_eur(amount: Column) -> Column:
    """``1.234,56 €``."""
    return F.concat(F.translate(F.format_number(amount, 2), ",.", ".,"), F.lit(" €"))


def strip_brackets(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\[.*?\]", ""))


def digit_ratio(text: Column) -> Column:
    """Share of characters that are digits, 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(F.lit(0.0))


#: Patterns of prompt injection, matched in any case.
INJECTIONS = (
    r"ignore (all |the )?(previous|above|prior) (instructions|prompts?|rules)",
    r"disregard (all |the )?(previous|above|prior)",
    r"you are now\b",
    r"act as (?:a |an )?(?:dan|developer|admin|root)",
    r"system\s*:",
    r"<\s*\/?\s*sys(?:tem)?\s*>",
    r"<\|im_(?:start|end)\|>",
    r"jailbreak",
    r"reveal (?:your )?(?:system )?prompt",
    r"tu prompt del sistema",
    r"olvida (?:todo lo |las )?(?:anterior|instrucciones)",
    r"ign[oó]ralo todo",
)


def sanitize(text: Column, limit: int = 5000) -> Column:
    """Control characters to spaces, zero-width and direction marks removed, trimmed and cut."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"[\u200B-\u200F\u202A-\u202E\uFEFF]", "")
    return F.substring(F.trim(plain), 1, limit)


def injections(text: Column) -> Column:
    """The patterns of ``INJECTIONS`` that a text matches."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in INJECTIONS)))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by its value wherever it stands, names in the order given; a null value is empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def wrap_array(raw: Column, field: str) -> Column:
    """A JSON text that is a bare array as an object with it as its only field; any other text unchanged."""
    return F.when(F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]")), F.concat(F.lit(f'{{"{field}": '), raw, F.lit("}"))).otherwise(raw)


def _whole_objects(raw: str | None) -> tuple[int, str | None]:
    """(number of whole objects in the first array field, JSON of that field with these alone)."""
    head = re.search(r'"([^"]+)"\s*:\s*\[', raw) if raw and raw.lstrip().startswith("{") else None
    if not head:
        return 0, None
    depth, n, end = 0, 0, None
    for mark in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\]]', raw[head.end() :], re.S):
        if mark[0] == "{":
            depth += 1
        elif mark[0] == "}":
            depth -= 1
            if depth == 0:
                n, end = n + 1, head.end() + mark.end()
        elif mark[0] == "]" and depth == 0:
            break
    fixed = f'{{"{head[1]}": [{raw[head.end() : end]}]}}' if n else None
    try:
        json.loads(fixed or "")
    except ValueError:
        return 0, None
    return n, fixed


def salvage_json(raw: Column) -> Column:
    """(n_items, fixed) of a JSON object that was cut off within its array field: the items that are whole."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_whole_objects(t) for t in texts], columns=["n_items", "fixed"])

    return F.pandas_udf(run, "n_items int, fixed string")(raw)


def cut(text: Column, limit: int = 4000) -> Column:
    """Texts over the limit end in an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("…"))).otherwise(text)


def first_named(record: Column, names: tuple[str, ...], default: Column) -> Column:
    """The number under the first of ``names`` that a JSON record has with a number; ``default`` for none."""
    return F.coalesce(*(F.get_json_object(record, f"$.{n}").try_cast("double") for n in names), default)
