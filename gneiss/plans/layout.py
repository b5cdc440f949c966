"""Budget lines from page text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.units import unit_dimension, unit_normalize
from gneiss.operators.ordered import canonical_chapters, with_chapter_filled, without_carry_over
from gneiss.sources.scratch import stored

#: Units as budgets write them, longer ones first.
UNITS = r"(?:m²|M²|m³|M³|m2|M2|m3|M3|ml|ML|kg|Kg|KG|kgs|Tn|tn|Ud|UD|ud|uds|UDS|PA|Pa|pa|hr|hrs|h|H|t|T|u|U|m|M|%)"
#: A line of a budget, coded with or without a C, and a row of quantity alone.
CODED = rf"^(C\d+\.\d+(?:\.\d+)?)\s+(?:Partida|partida)\s+({UNITS})\s+(.+?)$"
NUMBERED = rf"^(\d+\.\d+(?:\.\d+)?)\s+({UNITS})\s+(.+?)$"
QUANTITY = rf"^(\d+[,.]\d+)(?:\s+({UNITS}))?\s*$"
#: A chapter, with a C or numbered alone.
CHAPTER_CODED = r"^(C\d+)\s+Cap[ií]tulo\s+([A-ZÁÉÍÓÚÑ][^\n]+)$"
CHAPTER_NUMBERED = r"^(\d+)\s+([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s,Y]+)$"
#: A code that stands alone on its line.
CODE_ALONE = r"^(C?\d+(?:[.-]\d+)+)$"
#: A description under so many characters is short; so much after an item's title is looked at.
SHORT, SCANNED = 50, 1500
#: Fixed value: the chapter of items without one.
NO_CHAPTER = "Sin Capítulo"
#: Fixed value: the head of a table of lines, in any case.
TABLE_HEAD = r"(?iu)C[óo]digo\s+(?:Nat\s+)?(?:Ud|U/?d)\s+Resumen"


#: Words that open the description of a piece of work.
WORK_VERBS = (
    "Suministro", "Demolición", "Demolicion", "Instalación", "Instalacion",
    "Excavación", "Excavacion", "Colocación", "Colocacion", "Ejecución",
    "Ejecucion", "Desmontaje", "Desmontado", "Acondicionamiento",
    "Construcción", "Construccion", "Hormigón", "Hormigon", "Limpieza",
    "Vallado", "Replanteo", "Picado", "Pintura", "Aplicación", "Aplicacion",
    "Tratamiento", "Refuerzo", "Aislamiento",
)


def work_line(line: Column) -> Column:
    """Whether a line of 30 characters or more opens with a word of work, whatever its case."""
    first = F.lower(F.regexp_extract(F.trim(line), r"^(\S+)", 1))
    return (F.length(F.trim(line)) >= 30) & F.exists(F.array(*(F.lit(v.lower()) for v in WORK_VERBS)), lambda v: F.startswith(first, v))


#: Signs of prices, two points each, in any case; a price; a measured quantity at the end of a line.
PRICE_SIGNS = (
    r"\bPEM\b",
    r"\bPEC\b",
    r"Presupuesto de Ejecución Material",
    r"Presupuesto de Ejecución por Contrata",
    r"Gastos Generales",
    r"Beneficio Industrial",
    r"Total Presupuesto",
    r"Total Ejecución",
    r"IVA\s*21\s*%",
    r"Base Imponible",
    r"Importe Total",
    r"\bTOTAL\s+[\d.,]+\s*€",
)
PRICE = r"\d{1,3}(?:\.\d{3})*,\d{2}\s*€|\d+,\d{2}\s*€"
MEASURED = r"(?iu)(?m)\d+[,.]?\d*\s*(m2|m²|m3|m³|ml|ud|u\.|kg|t|l\.|pa|h)\s*$"


def price_role(text: Column) -> Column:
    """Struct (price_score, measurement_score, role): whether a text has prices (OUTPUT) or measurements to be priced (INPUT)."""
    signs = sum((F.when(text.rlike(f"(?iu){p}"), 2).otherwise(0) for p in PRICE_SIGNS), F.lit(0))
    price = signs + F.least(F.regexp_count(text, F.lit(PRICE)), F.lit(10))
    measured = F.regexp_count(text, F.lit(MEASURED))
    role = F.when(F.trim(text) == "", "UNKNOWN").when(price >= 3, "OUTPUT").when(((price == 0) & (measured >= 3)) | ((price <= 2) & (measured >= 5)), "INPUT").otherwise("UNKNOWN")
    return F.struct(price.alias("price_score"), measured.alias("measurement_score"), role.alias("role"))


def line_family(line: Column) -> Column:
    """Which pattern of budgets a line has: coded or numbered item or chapter, quantity; null for other text."""
    families = (("item_coded", CODED), ("item_numbered", NUMBERED), ("chapter_coded", CHAPTER_CODED), ("chapter_numbered", CHAPTER_NUMBERED), ("quantity", QUANTITY))
    return F.coalesce(*(F.when(line.rlike(pattern), F.lit(name)) for name, pattern in families))


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = 40) -> DataFrame:
    """(doc_id, page_no, text) of plain texts: a form feed ends a page, and so do ``lines`` lines; pages count from 1."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\f", -1)).alias("part", "text"))
    cut = parts.select("doc_id", "part", F.split("text", "\n", -1).alias("ls"))
    starts = cut.select("doc_id", "part", "ls", F.posexplode(F.sequence(F.lit(1), F.size("ls"), F.lit(lines))).alias("piece", "at"))
    pages = starts.select("doc_id", "part", "piece", F.array_join(F.slice("ls", F.col("at"), lines), "\n").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("part", "piece")
    return pages.select("doc_id", F.row_number().over(order).alias("page_no"), "text")


def _digit_first(text: Column) -> Column:
    return F.substring(text, 1, 1).between("0", "9")


def _opens(line: Column, pattern: str) -> Column:
    """Whether a line begins as one with this pattern of an item or a chapter must: most lines don't, and need no pattern tried."""
    return F.startswith(line, F.lit("C")) if pattern in (CODED, CHAPTER_CODED) else _digit_first(line)


def _has(line: Column, *patterns: str) -> Column:
    """Whether a line has one of these patterns of items or chapters."""
    return reduce(or_, (_opens(line, p) & line.rlike(p) for p in patterns))


def _first(line: Column, group: int, *patterns: str) -> Column:
    """A group of the first of these patterns of items or chapters that a line has, null for none."""
    return F.coalesce(*(F.when(_opens(line, p), F.nullif(F.regexp_extract(line, p, group), F.lit(""))) for p in patterns))


def _part(line: Column, group: int, coded: str = CODED, numbered: str = NUMBERED) -> Column:
    """A group of the pattern of a line that is known to have one of these two: its first character says which."""
    return F.when(F.startswith(line, F.lit("C")), F.regexp_extract(line, coded, group)).otherwise(F.regexp_extract(line, numbered, group))


def _quantity(line: Column) -> Column:
    """The quantity of a line that has nothing else but a unit, null for other lines."""
    text = F.trim(line)
    return F.when(_digit_first(text), F.replace(F.regexp_extract(text, QUANTITY, 1), F.lit(","), F.lit(".")).try_cast("double"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line) with what each line is; ``pages`` has (doc_id, page_no, text)."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    part = lambda i: _first(F.col("line"), i, CODED, NUMBERED)
    return lines.select("doc_id", "page_no", "line_no", "line", part(1).alias("code"), part(2).alias("unit"), part(3).alias("title"), _quantity(F.col("line")).alias("quantity"))


def _quantity_alone(line: Column) -> Column:
    """Whether a line has nothing but a number and at most one word more."""
    words = F.split(F.trim(line), r"\s+")
    return (F.size(words) <= 2) & F.replace(words[0], F.lit(","), F.lit(".")).try_cast("double").isNotNull()


def profile(pages: DataFrame) -> DataFrame:
    """What the fingerprint and the routes need of each document, in one shuffle: a row for each doc_id.

    n_pages, n_chars, has_head, items and quantities by page (``by_page``), ``codes`` of all items, ``heads`` of chapters
    with their places, and ``cross_page``: items at the foot of a page whose description seems to go on overleaf.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.col("_lines")
    item = lambda x: F.struct(_part(x, 1).alias("code"), F.trim(_part(x, 3)).alias("title"))
    names = (CHAPTER_CODED, CHAPTER_NUMBERED)
    chapter = lambda x, i: F.struct(F.col("page_no"), F.when(F.startswith(x, F.lit("C")), 0).otherwise(1).alias("kind"), (i - 1).alias("at"), _part(x, 1, *names).alias("prefix"), F.trim(_part(x, 2, *names)).alias("name"))
    rows = pages.select("doc_id", "page_no", text.alias("text"), F.split(text, "\n", -1).alias("_lines"))
    rows = rows.withColumn("_items", F.filter(lines, lambda x: _has(x, CODED, NUMBERED))).select(
        "doc_id", "page_no", "text", F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0)).alias("opening"),
        F.transform("_items", lambda x: _part(x, 1)).alias("codes"), F.transform("_items", item).alias("items"),
        F.size(F.filter(lines, lambda x: _digit_first(F.trim(x)) & F.trim(x).rlike(QUANTITY))).alias("quantities"),
        F.transform(_places(lambda x: _has(x, *names)), lambda i: chapter(_line(i), i)).alias("heads"),
    )
    after = F.lead("opening").over(Window.partitionBy("doc_id").orderBy("page_no"))
    at = rows.withColumn("overleaf", F.coalesce(work_line(after), F.lit(False)))
    rest = lambda x: F.substring(F.col("text"), F.instr("text", x["title"]) + F.length(x["title"]), F.lit(SCANNED))
    own = lambda x: F.length(F.trim(F.array_join(F.filter(F.split(rest(x), "\n", -1), lambda y: (F.trim(y) != "") & ~_quantity_alone(y)), "\n")))
    broken = F.when(F.col("overleaf"), F.filter("items", lambda x: own(x) < SHORT)).otherwise(F.filter("items", lambda _: F.lit(False)))
    return at.withColumn("broken", broken).groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.sum(F.length("text") + 1).alias("n_chars"),
        F.max(F.col("text").rlike(TABLE_HEAD)).alias("has_head"),
        F.collect_list(F.struct("page_no", F.size("codes").alias("items"), "quantities")).alias("by_page"),
        F.flatten(F.collect_list("codes")).alias("codes"),
        F.array_sort(F.flatten(F.collect_list("heads"))).alias("heads"),
        F.array_sort(F.flatten(F.collect_list(F.transform("broken", lambda x: F.struct(F.col("page_no"), x["code"].alias("code")))))).alias("cross_page"),
    )


def _layout(profiles: DataFrame) -> DataFrame:
    """``profiles`` with layout, confidence and n_items: from where items and quantities stand in the pages."""
    third = F.floor(F.col("n_pages") / 3)
    total = lambda field, keep: F.aggregate(F.filter("by_page", keep), F.lit(0), lambda n, x: n + x[field])
    front, back = (lambda x: x["page_no"] <= third), (lambda x: x["page_no"] > F.col("n_pages") - third)
    n = F.size("codes")
    back_rows = total("quantities", back)
    annexed = (F.col("n_pages") >= 6) & (total("items", front) > total("items", back) * 2) & (back_rows > total("quantities", front) * 2) & (back_rows >= 5)
    blank, few = F.col("n_chars") - 1 < 200, n < 3
    layout = F.when(blank | few, "UNKNOWN").when(annexed, "TWO_PHASE_ANNEXED").otherwise("INLINE_WITH_TITLES")
    confidence = F.when(blank, 1.0).when(few, 0.6).when(annexed, 0.85).when(n >= 20, 0.9).when(F.col("has_head"), 0.85).otherwise(0.65)
    return profiles.withColumn("layout", layout).withColumn("confidence", confidence).withColumn("n_items", n)


def classify(pages: DataFrame) -> DataFrame:
    """(doc_id, layout, confidence, n_items) of each document; pages count from 1."""
    return _layout(profile(pages)).select("doc_id", "layout", "confidence", "n_items")


def fingerprint(pages: DataFrame) -> DataFrame:
    """The structure of each document: counts, chapters, items that go on overleaf, and anomalies.

    chapters: of each prefix the name seen first, its items and page; cross_page: (page, code) of items that lack a
    description of ``SHORT`` characters before the page ends while the next page opens with a piece of work. These need a
    model, the others don't. anomalies: prefixes with several names, and these. A page without text counts as a
    page; a document without items has empty lists.
    """
    p = _layout(profile(pages))
    prefix = lambda c: F.upper(F.substring_index(c, ".", 1))
    prefixes = F.array_distinct(F.transform("heads", lambda h: h["prefix"]))
    of = lambda x: F.filter("heads", lambda h: h["prefix"] == x)
    named = lambda x: F.array_sort(F.array_distinct(F.transform(of(x), lambda h: h["name"])))
    n_own = lambda x: F.size(F.filter("codes", lambda c: prefix(c) == x))
    entry = lambda x: F.struct(x.alias("prefix"), of(x)[0]["name"].alias("name"), n_own(x).alias("n_items"), of(x)[0]["page_no"].alias("first_page"))
    anomalies = F.filter(F.transform(prefixes, lambda x: F.struct(x.alias("prefix"), named(x).alias("names"))), lambda a: F.size(a["names"]) > 1)
    n_cross = F.size("cross_page")
    return p.select(
        "doc_id", F.col("n_pages").cast("int").alias("n_pages"), (F.col("n_chars") - F.col("n_pages") > 200).alias("extractable"), "layout", "confidence", "n_items",
        F.greatest(F.lit(0), F.col("n_items") - n_cross).alias("n_plain"), n_cross.alias("n_needs_model"),
        F.transform(prefixes, entry).alias("chapters"), "cross_page", anomalies.alias("anomalies"),
    )


def _page_items(pages: DataFrame, described: bool, *also: str) -> DataFrame:
    """A row for each item with its place in the document (``at``), its ``block_sums`` and the columns ``also`` of its page, dealt by document.

    An item ends with its page, so pages are cut into items before anything is shuffled; only the number of items before a page
    comes from other pages.
    """
    rows = pages.select("doc_id", "page_no", *also, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"))
    rows = rows.withColumn("_heads", _places(lambda x: _has(x, CODED, NUMBERED)))
    own = lambda at, k: F.slice("_lines", at, F.coalesce(F.get("_heads", k + 1), F.size("_lines") + 1) - at)
    cut = own if described else lambda at, k: F.filter(own(at, k), lambda x, i: (i == 0) | _quantity(x).isNotNull())
    rows = rows.select("doc_id", "page_no", *also, F.transform("_heads", cut).alias("_items"))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum(F.size("_items")).over(before), F.lit(0)))
    each = placed.select("doc_id", "page_no", *also, "_before", F.posexplode("_items").alias("_n", "_own"))
    head, rest = F.col("_own")[0], F.slice("_own", F.lit(2), F.size("_own"))
    each = each.withColumn("_quantities", F.filter(F.transform(rest, _quantity), lambda x: x.isNotNull()))
    columns = ["doc_id", "page_no", *also, (F.col("_before") + F.col("_n") + 1).alias("at"), _part(head, 1).alias("code")]
    if described:
        texts = F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: (x != "") & _quantity(x).isNull())
        columns += [_part(head, 2).alias("unit"), _part(head, 3).alias("title"), F.nullif(F.array_join(texts, " "), F.lit("")).alias("description")]
    n = F.size("_quantities")
    whole = F.when(n > 0, F.aggregate("_quantities", F.lit(0.0), lambda a, x: a + x))
    return each.select(*columns, F.get("_quantities", F.lit(0)).alias("_first"), whole.alias("_sum"), n.cast("bigint").alias("_rows"))


def extract_items(pages: DataFrame, nothing_left: float | None = 0.0, described: bool = True) -> DataFrame:
    """(doc_id, page_no, at, code, unit, title, description, quantity): each item with the lines up to the next.

    Quantities of an item are summed; a first one that repeats the item before's total is a carry-over, and
    ``nothing_left`` is the quantity of an item that had no other. ``at`` is the item's place in the document. Pages are read
    once; without ``described``, unit, title and description are left out.
    """
    found = without_carry_over(_page_items(pages, described), ["doc_id"], "at", "quantity", nothing_left, dealt=True)
    return found.select("doc_id", "page_no", "at", "code", *(("unit", "title", "description") if described else ()), "quantity")


def _priced_unit(items: DataFrame, route: str, *also: str) -> DataFrame:
    """The columns that all routes share, and ``also``."""
    return items.select(
        "doc_id", F.lit(route).alias("route"), F.lit(None).cast("string").alias("reason"), "page_no", "code", "unit", unit_normalize(F.col("unit")).alias("unit_normalized"),
        unit_dimension(F.col("unit")).alias("unit_dimension"), "chapter", "description", "quantity", *also,
    )


def inline_items(pages: DataFrame, short: float) -> DataFrame:
    """Items that stand beside their descriptions; of a document with a larger share than ``short`` of short descriptions the first row, ``refused``.

    ``pages`` has ``chapters`` too: of each prefix the first name of its chapter. An item without a description has its
    title, without a quantity one piece.
    """
    items = _page_items(pages, True, "chapters").withColumn("chapter", F.coalesce(F.try_element_at("chapters", F.upper(F.substring_index("code", ".", 1))), F.lit(NO_CHAPTER)))
    named = canonical_chapters(items.drop("chapters"), ["doc_id"], "at")
    brief = (F.coalesce(F.length("description"), F.lit(0)) < SHORT).cast("int")
    by = Window.partitionBy("doc_id")
    judged = named.withColumn("refused", F.avg(brief).over(by) > short).withColumn("_n", F.row_number().over(by.orderBy("at"))).where("NOT refused OR _n = 1").drop("_n")
    found = without_carry_over(judged, ["doc_id"], "at", "quantity", None, dealt=True)
    return found.select("doc_id", "refused", "page_no", "at", "code", "unit", "chapter", F.coalesce("description", "title").alias("description"), F.coalesce("quantity", F.lit(1.0)).alias("quantity"))


def annexed_items(pages: DataFrame) -> DataFrame:
    """Items of documents whose first half describes them and whose second half has their quantities.

    A description that a page's foot cuts off (it doesn't end in a full stop) takes over the text at the head of the next page.
    The second half has codes alone on a line, each with the quantities after it; both halves meet on the
    digits of the code, the last of repeated codes counts, and an item without a quantity has 0. Chapters are
    carried on from the headings before.
    """
    n_pages = F.count("*").over(Window.partitionBy("doc_id"))
    halves = pages.select("doc_id", "page_no", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"), (F.col("page_no") * 2 <= n_pages).alias("_front"))
    items = with_chapter_filled(_described(halves.where("_front")), ["doc_id"], "at", dealt=True)
    items = items.withColumn("chapter", F.coalesce(F.nullif("chapter", F.lit("")), F.lit(NO_CHAPTER)))
    named = canonical_chapters(items, ["doc_id"], "at").withColumn("digits", _digits(F.col("code")))
    out = named.join(_counted(halves.where("NOT _front")), ["doc_id", "digits"], "left")
    return out.select("doc_id", "page_no", "at", "code", "unit", "chapter", F.coalesce(F.nullif("description", F.lit("")), F.col("title")).alias("description"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def _digits(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "")


def _line(i: Column) -> Column:
    """The line of this number, from 1, of a page's ``_lines``."""
    return F.get(F.col("_lines"), i - 1)


def _places(keep: Callable[[Column], Column]) -> Column:
    """Numbers of the lines of a page that ``keep``."""
    return F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: keep(_line(i)))


def _described(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, at, code, unit, title, description, chapter) of the items of first halves, dealt by document; ``pages`` has ``_lines``.

    Pages are cut into items, and what comes from other pages (the number of items before, the last heading, the next page's
    tail) is asked for page by page.
    """
    names = (CHAPTER_CODED, CHAPTER_NUMBERED)
    heading = lambda x: F.concat(_part(x, 1, *names), F.lit(" "), F.trim(_part(x, 2, *names)))
    plain = lambda x: (F.trim(x) != "") & ~_has(x, CODED, NUMBERED, *names) & _quantity(x).isNull() & ~x.rlike(TABLE_HEAD)
    text = lambda first, n: F.array_join(F.transform(F.filter(F.slice("_lines", first, n), plain), lambda x: F.trim(x)), " ")
    rows = pages.withColumn("_heads", _places(lambda x: _has(x, CODED, NUMBERED))).withColumn("_names", _places(lambda x: _has(x, *names)))
    name = lambda at: heading(_line(F.try_element_at(F.filter("_names", lambda i: i < at), F.lit(-1))))
    body = lambda at, k: text(at + 1, F.coalesce(F.get("_heads", k + 1), F.size("_lines") + 1) - at - 1)
    item = lambda at, k: F.struct(_line(at).alias("head"), body(at, k).alias("description"), name(at).alias("chapter"))
    rows = rows.select(
        "doc_id", "page_no", F.transform("_heads", item).alias("_items"), heading(_line(F.try_element_at("_names", F.lit(-1)))).alias("_name"),
        F.nullif(F.trim(text(F.lit(1), F.coalesce(F.get("_heads", F.lit(0)) - 1, F.size("_lines")))), F.lit("")).alias("_tail"),
    )
    order = Window.partitionBy("doc_id").orderBy("page_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"_before": F.coalesce(F.sum(F.size("_items")).over(before), F.lit(0)), "_carried": F.last("_name", ignorenulls=True).over(before), "_next": F.lead("_tail").over(order)})
    each = placed.select("doc_id", "page_no", "_before", "_carried", F.size("_items").alias("_size"), "_next", F.posexplode("_items").alias("_n", "_item"))
    own = F.col("_item.description")
    cut = (F.col("_n") == F.col("_size") - 1) & F.col("_next").isNotNull() & ~F.rtrim(own).rlike(r"\.$")
    part = lambda i: _part(F.col("_item.head"), i)
    return each.select(
        "doc_id", "page_no", (F.col("_before") + F.col("_n") + 1).alias("at"), part(1).alias("code"), part(2).alias("unit"), part(3).alias("title"),
        F.trim(F.when(cut, F.concat(F.rtrim(own), F.lit(" "), "_next")).otherwise(own)).alias("description"),  # a tail may be all of it
        F.coalesce("_item.chapter", "_carried").alias("chapter"),
    )


def _counted(pages: DataFrame) -> DataFrame:
    """(doc_id, digits, quantity) of second halves: what stands after the last of a code's turns; ``pages`` has ``_lines``."""
    alone = lambda x: F.when((F.startswith(x, F.lit("C")) | _digit_first(x)) & _quantity(x).isNull(), F.nullif(F.regexp_extract(x, CODE_ALONE, 1), F.lit("")))
    lines = F.transform("_lines", lambda x: F.struct(alone(F.trim(x)).alias("code"), _quantity(x).alias("quantity")))
    rows = pages.select("doc_id", "page_no", F.filter(lines, lambda x: x["code"].isNotNull() | x["quantity"].isNotNull()).alias("_lines"))
    rows = rows.withColumn("_codes", _places(lambda x: x["code"].isNotNull()))
    total = lambda first, n: F.aggregate(F.slice("_lines", first, n), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x["quantity"], a, x["quantity"]))
    turn = lambda at, k: F.struct(_line(at)["code"].alias("code"), total(at, F.coalesce(F.get("_codes", k + 1), F.size("_lines") + 1) - at).alias("quantity"))
    leading = F.struct(F.lit(None).cast("string").alias("code"), total(F.lit(1), F.coalesce(F.get("_codes", F.lit(0)) - 1, F.size("_lines"))).alias("quantity"))
    rows = rows.where(F.size("_lines") > 0).select("doc_id", "page_no", F.size("_codes").alias("_size"), F.concat(F.array(leading), F.transform("_codes", turn)).alias("_turns"))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("_size") > 0, F.element_at("_turns", -1)["code"])
    placed = rows.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_carried": F.last(last, ignorenulls=True).over(before)})
    each = placed.select("doc_id", "_before", "_carried", F.posexplode("_turns").alias("_n", "_turn"))
    of = F.when(F.col("_n") == 0, F.col("_carried")).otherwise(F.col("_turn.code"))
    each = each.select("doc_id", (F.col("_before") + F.col("_n")).alias("turn"), _digits(of).alias("digits"), F.col("_turn.quantity").alias("quantity")).where("digits IS NOT NULL")
    turns = each.groupBy("doc_id", "turn").agg(F.max("digits").alias("digits"), F.sum("quantity").alias("quantity"))
    return turns.groupBy("doc_id", "digits").agg(F.max_by(F.coalesce("quantity", F.lit(0.0)), "turn").alias("quantity"))


def extract_documents(pages: DataFrame, confidence: float = 0.85, items: int = 5, short: float = 0.3) -> DataFrame:
    """Items of all documents that patterns can read, by route, and one row with the reason for each that needs a model.

    Documents with a layout of two halves go the ``annexed`` route. The others must pass three gates to go
    ``inline``: a layout known with ``confidence``, at least so many ``items``, and no more than a share ``short`` of
    them with short descriptions. ``pages`` (doc_id, page_no from 1, text) is read several times: hand in a table.
    """
    known = _layout(profile(pages))
    reason = F.when(F.col("layout") == "UNKNOWN", "layout").when(F.col("confidence") < confidence, "confidence").when(F.col("n_items") < items, "few_items")
    of = lambda x: F.filter("heads", lambda h: h["prefix"] == x)[0]
    chapters = F.transform(F.array_distinct(F.transform("heads", lambda h: h["prefix"])), lambda x: F.struct(x, F.concat(x, F.lit(" "), of(x)["name"])))
    route = F.when(F.col("layout") == "TWO_PHASE_ANNEXED", "annexed").when(reason.isNull(), "inline").otherwise("model")
    routed = known.select("doc_id", route.alias("route"), reason.alias("reason"), F.when(route == "inline", F.map_from_entries(chapters)).alias("chapters"))
    routed = stored(routed, "routes")  # worked out once for the three ways
    by = lambda route: routed.where(F.col("route") == route)
    found = _priced_unit(inline_items(pages.join(by("inline").select("doc_id", "chapters"), "doc_id"), short), "inline", "refused")
    refused = {"route": F.lit("model"), "reason": F.lit("short_descriptions")}
    inline = found.select("doc_id", *(F.when(F.col("refused"), refused.get(c, F.lit(None))).otherwise(F.col(c)).alias(c) for c in found.columns if c not in ("doc_id", "refused")))
    annexed = _priced_unit(annexed_items(pages.join(by("annexed").select("doc_id"), "doc_id", "left_semi")), "annexed")
    kinds = dict(annexed.dtypes)
    rest = by("model").select("doc_id", "route", "reason", *(F.lit(None).cast(kinds[c]).alias(c) for c in annexed.columns[3:]))
    return inline.unionByName(annexed).unionByName(rest)
