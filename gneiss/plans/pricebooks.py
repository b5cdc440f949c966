"""Items of price books from their text, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line that opens an item, with the price before the description or at the end.
PRICE_FIRST = r"^([A-Z0-9][a-zA-Z0-9\.]*?)(?:\s+|(?<=\d)(?=[a-zA-Z%]))([a-zA-Z0-9%\./²³]+)\s+([-]?\d{1,3}(?:\.\d{3})*,\d{1,2})\s+(.+)$"
PRICE_LAST = r"^([A-Z0-9\.]+)\s+([a-zA-Z0-9%\.\/]+)\s+(.+)\s+([-]?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?)$"
#: Marks of lines that are left out, page feet, headings in capitals and in title case, components.
JUNK = ("PRECIOS", "Página", "-- 1 of")
PAGE_FOOT = r"-- \d+ of \d+ --"
CAPITALS = r"^[A-ZÁÉÍÓÚÑ\s\.]+$"
TITLE_CASE = r"^(?:[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑ0-9]*\s*)+$"
COMPONENT = r"^([a-z]{2}\d|%)"
#: What is cut off the end of a description, in this order.
TAILS = (
    r"\s+(?:[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑ0-9\.\-]*\s+)+-- \d+ of \d+ --.*$",
    r"\s+(?:[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑ0-9]*\s*){2,}$",
    r"\s+[A-Z]\d{4}\.\d{4}.*$",
    r"\s+[a-z]{2}\d{2,}.*$",
)
#: A heading has fewer characters.
HEADING = 60

ITEM, HEAD, PART, TEXT, NONE = "item", "heading", "component", "text", "none"


def _cleaned(text: Column) -> Column:
    for tail in TAILS:
        text = F.regexp_replace(text, tail, "")
    return text


def book_lines(books: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, kind, code, unit, price, words) of every line of ``books`` (doc_id, text).

    kind: what a line is by itself; a line of text belongs to the item before it, if there is one.
    """
    lines = books.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r", -1)).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", F.trim("raw").alias("line"))
    line = F.col("line")
    junk = (line == "") | F.exists(F.array(*map(F.lit, JUNK)), lambda x: F.contains(line, x))
    first, last = line.rlike(PRICE_FIRST), line.rlike(PRICE_LAST)
    part = lambda i, j: F.when(first, F.regexp_extract(line, PRICE_FIRST, i)).when(last, F.regexp_extract(line, PRICE_LAST, j))
    heading = ((line.rlike(CAPITALS) & (F.length(line) > 4)) | line.rlike(TITLE_CASE)) & (F.length(line) < HEADING)
    kind = F.when(junk, NONE).when(first | last, ITEM).when(line.rlike(PAGE_FOOT), NONE).when(heading, HEAD).when(line.rlike(COMPONENT), PART).otherwise(TEXT)
    price = F.replace(F.replace(part(3, 4), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    own = {"code": part(1, 1), "unit": part(2, 2), "price": price, "words": _cleaned(F.when(first | last, F.trim(part(4, 3))).otherwise(line))}
    marked = lines.withColumn("kind", kind)
    return marked.select("doc_id", "line_no", "line", "kind", *(F.when(F.col("kind").isin(ITEM, TEXT) if c == "words" else F.col("kind") == ITEM, x).alias(c) for c, x in own.items()))


def parse_books(books: DataFrame) -> DataFrame:
    """(doc_id, item_no, section, code, unit, price, description, components): the items of each book, numbered from 1.

    An item goes up to the next one: lines of text go on with its description, components are listed by
    their lines, page feet and headings are left out. section is the heading last seen before the item. Every book is
    one run of lines through windows that hold counters, so a large book is a large task but no large group; only an
    item's own lines are collected. What stands before the first item is dropped; a null text has no items.
    """
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda kind, value: F.last(F.when(F.col("kind") == kind, F.col(value)), ignorenulls=True).over(upto)
    rows = book_lines(books).select("*", F.sum((F.col("kind") == ITEM).cast("int")).over(upto).alias("item_no"), seen(HEAD, "line").alias("section"))
    own = lambda kind, value: F.array_sort(F.collect_list(F.when(F.col("kind").isin(kind), F.struct("line_no", F.col(value).alias("x")))))
    opening = lambda c: F.max_by(c, F.when(F.col("kind") == ITEM, 1)).alias(c)
    items = rows.where("item_no > 0").groupBy("doc_id", "item_no").agg(
        *map(opening, ("section", "code", "unit", "price")),
        F.array_join(F.transform(own([ITEM, TEXT], "words"), lambda x: x["x"]), " ").alias("description"),
        F.transform(own([PART], "line"), lambda x: x["x"]).alias("components"),
    )
    return items.select("doc_id", F.col("item_no").cast("int").alias("item_no"), "section", "code", "unit", F.coalesce("price", F.lit(0.0)).alias("price"), "description", "components")
